"""Noise in text from scanned pages (problem 1).

1. One pass over all texts counts words, neighbouring words, short segments of
   lines, and section names with and without a number.
2. Skip-gram vectors with negative sampling are trained on the counted pairs.
3. A rare word is linked to a more frequent one that a plausible misreading of
   glyphs leads to, if the vector learned for the frequent word agrees with the one
   composed of the rare word's neighbours. The less the counts and the word's shape
   tell of a misreading, the more they must: a rare word of its own, one glyph away
   from a frequent one, stands among other words and stays.
4. Segments that hardly ever occur but as a whole segment are page furniture.
5. A second pass corrects linked words (by the words around them where several
   corrections are possible), drops furniture and page numbers, joins divided
   words and reflows the lines, and reports what it met.

All counts cover all texts. What is broadcast is checked first: if links, known
words or furniture exceed MAX_BROADCAST rows, each row gets its own by shuffle
joins instead.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle

# What is read -> what was printed, glyph pairs that scans confuse.
GLYPHS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("ø", "a"), ("á", "a"), ("à", "a"), ("ó", "o"), ("é", "e"), ("í", "i"),
    ("l", "i"), ("i", "l"), ("c", "e"), ("e", "c"), ("q", "g"), ("b", "h"), ("h", "b"), ("u", "n"), ("n", "u"), ("f", "t"), ("v", "y"),
    ("rn", "m"), ("m", "rn"), ("nn", "m"), ("m", "in"), ("in", "m"), ("ni", "m"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("li", "h"), ("h", "li"), ("vv", "w"), ("w", "vv"), ("n", "ri"), ("ri", "n"), ("ft", "tt"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
]
# Words after a hanging hyphen, as in "edge- and corner-sharing".
AFTER_HANGING = frozenset("and or nor to und oder et ou y o as".split())
# Words that may follow a name in a running header, besides numbers.
HEADER_TAILS = frozenset("# vol no pp issue".split())
HYPHENS = "-‐‑"
SOFT = "\xad¬"
_DIVIDING = frozenset(HYPHENS + SOFT)

#: A word must be this many times as frequent as the word it corrects.
FREQUENCY_RATIO = 4.0
#: The same for words of a shape that no word has, and for words without neighbours to compare.
ODD_RATIO, LONE_RATIO = 1.5, 8.0
#: Cosine that vectors must reach at a ratio of SIM_AT; it falls by SIM_SLOPE with each doubling of the ratio, to SIM_LEAST
#: (a misreading of a common word is a thousand times rarer than the word; another word seldom is), and by SIM_ODD for an odd shape or an accent that the corrected word lacks.
SIM_PLAIN, SIM_AT, SIM_SLOPE, SIM_LEAST, SIM_ODD = 0.4, 8.0, 0.06, 0.05, 0.3
#: It falls too by SIM_NOISE / sqrt(neighbours met), as few neighbours tell little, and the product of the vectors, which
#: is about the log of how much likelier the neighbours make the word, may miss it by DOT_SLACK: vectors near the average word tell nothing.
SIM_NOISE, DOT_SLACK = 1.0, 0.2
MIN_LENGTH = 4
#: A segment is furniture if it occurs so often and so many of all occurrences of its rarest pair of words are the whole segment.
FURNITURE_COUNT, FURNITURE_SHARE = 3, 0.75
SEGMENT_WORDS = 9
#: Vectors: the most frequent words have one each, all others share SHARED_ROWS by hash, so that every pair is trained on.
VECTOR_WORDS, SHARED_ROWS = 20_000, 1 << 14
#: Dimensions, rounds, passes of a task over its pairs in a round, negative samples a pair, and how many of them a batch draws.
DIMS, EPOCHS, PASSES, NEGATIVES, DRAWN = 24, 4, 3, 4, 64
#: Steps a round takes at least, in more passes where pairs are few, pairs of a step, and the longest change of a vector in one.
LEAST_STEPS, BATCH, MOST_CHANGE = 100, 2048, 0.5
#: Words up to this length are expanded to all their printed forms; of longer ones only the first letters are.
FORM_LETTERS, KEY_LETTERS = 14, 10
WINDOW = 2
MAX_BROADCAST = 400_000
#: What makes a word known: this count, and this share of all words in a large corpus, where misreadings recur too.
KNOWN_COUNT, KNOWN_SHARE = 4, 1e-7
#: Size of a table of marks by hash, which Repairer takes in place of a set of known words.
KNOWN_BUCKETS = 1 << 20

_WORD = re.compile(r"[^\W_]+(?:![^\W\d_][^\W_]*)*")
_SEGMENTS = re.compile(r"  +| [/·] ")
_LINES = re.compile(r"\r\n|[\r\n\v\f\x85  ]")
_PAGE = re.compile(r"(?:(?:page|seite|p\.|pp\.|s\.)\s*)?(?:s-?)?\d{1,5}|[-–—]\s*\d{1,5}\s*[-–—]|\[\s*\d{1,5}\s*\]|\d{1,5}\s*\|\s*\d{1,5}", re.I)
_CLEAR_PAGE = r"page\s*\d{1,5}|p\.\s*\d{1,5}|s-\d{1,5}|[-–—]\s*\d{1,5}\s*[-–—]|\[\d{1,5}\]|\d{1,5}\s*\|\s*\d{1,5}"
_TAIL_PAGE = re.compile(rf"^(.*?\S)\s+({_CLEAR_PAGE}|\d{{1,5}})$", re.I | re.S)
_HEAD_PAGE = re.compile(rf"^({_CLEAR_PAGE}|\d{{1,5}})\s+(\S.*)$", re.I | re.S)
_CHARGED = re.compile(rf"(?:[\])]\d*|(?:^|[^\w])(?:\w*(?:Sb|Cl|Br|F|I|At)\d*))[{HYPHENS}]$")
#: Of the glyph pairs above, those of one sign that is no letter of the word, for words too short to be linked.
_ONE_GLYPH = str.maketrans({a: b for a, b in reversed(GLYPHS) if len(a) == len(b) == 1 and not (a.isascii() and a.isalpha())})
#: No misreading of a word of HEADER_TAILS, or number there of a page or year, is longer.
LONGEST_TAIL = 9
_ODD = re.compile(r"[^\W\d_][\d!ø]|[\d!ø][^\W\d_]|[ﬀ-ﬆ]")


class _Spaces(dict):
    """Translation of every character that is no letter or digit to a blank."""

    def __missing__(self, c: int) -> str:
        self[c] = v = chr(c) if chr(c).isalnum() else " "
        return v


_KEEP = _Spaces({1: "\x01", 2: "\x02", 3: "\x03", 33: "!"})
_LOOSE_MARK = re.compile(r"!(?![^\W\d_])")
#: The same for the bytes of ASCII text; bytes of other characters stay.
_KEEP_BYTES = bytes(i if i > 127 or i in (1, 2, 3, 33) or chr(i).isalnum() else 32 for i in range(256))


def _cut(s: str) -> list[str]:
    """Words in lower case; \x01 for a line's end or another bound of segments, \x02
    for a text's end, \x03 at the end of the first half of a divided word."""
    s = s.lower().replace("\r\n", "\n").replace("\r", "\n").replace("  \n", "\n").replace(" \n", "\n")
    for mark in HYPHENS + SOFT:
        s = s.replace(mark + "\n", "\x03 \x01 ")
    for bound in ("\n", "  ", " / ", " · "):
        s = s.replace(bound, " \x01 ")
    for c in set(s):
        if not c.isascii() and not c.isalnum():
            s = s.replace(c, " ")
    return _LOOSE_MARK.sub(" ", s).encode("utf-8", "surrogatepass").translate(_KEEP_BYTES).decode("utf-8", "surrogatepass").split()


def _words_of(s: str) -> list[str]:
    """Words of a text that holds no '!', in lower case."""
    if s.isascii():
        return s.lower().encode().translate(_KEEP_BYTES).decode().split()
    return s.lower().translate(_KEEP).split()


# --- counting -----------------------------------------------------------------


class _Counts:
    """Counts of one task: words are numbered, pairs are counted as numbers."""

    BOUND, END, BROKEN = 1, 2, 3

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.words: list[str] = ["", "", "", ""]
        self.pairs: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {"p1": [], "p2": []}
        self.uni = np.zeros(0, np.int64)
        self.segments: dict[str, Counter] = {"": Counter(), "half": Counter()}
        self.sections: Counter = Counter()
        self.asked: set[str] = set()

    def _new(self, t: str) -> int:
        if t == "\x02":
            n = self.END
        elif t[-1] == "\x03":  # the first half of a divided word
            n = self.BROKEN
        elif t[0] == "\x01":
            n = self.BOUND
        else:
            w = "#" if t.isdigit() else t
            n = self.ids.get(w) if w != t else None
            if n is None:
                n = len(self.words)
                self.words.append(w)
                self.ids[w] = n
        self.ids[t] = n
        return n

    def add(self, texts: list[str], titles: bool = False) -> None:
        get, new = self.ids.get, self._new
        a = np.array([get(t) or new(t) for t in _cut(" \x02 ".join(texts) + " \x02")], np.int64)
        if not len(a):
            return
        count = np.bincount(a, minlength=len(self.words))
        count[: len(self.uni)] += self.uni
        self.uni = count
        if titles:
            return
        w = a[a != self.BOUND]
        for kind, off in (("p1", 1), ("p2", 2)):
            x, y = w[:-off], w[off:]
            ok = (x > 3) & (y > 3)
            if off == 2:
                ok &= w[1:-1] > 3
            self._pair(kind, x[ok] << 32 | y[ok])
        tails = np.array([self.ids[t] for t in HEADER_TAILS if t in self.ids], np.int64)
        for _ in range(4):
            edge = np.r_[(a[1:] == self.BOUND) | (a[1:] == self.END), True]
            drop = edge & np.isin(a, tails)
            if not drop.any():
                break
            a = a[~drop]
        cut = np.flatnonzero(a <= self.END)
        begin = np.r_[0, cut[:-1] + 1]
        size = cut - begin
        # what follows half a word may be its other half, and counts only if it is a segment elsewhere
        half = (begin > 1) & (a[np.maximum(begin - 2, 0)] == self.BROKEN) & (a[begin - 1] == self.BOUND)
        short = (size > 0) & (size <= SEGMENT_WORDS)
        raw = a.tobytes()
        for which, mark in ((short & ~half, ""), (short & half, "half")):
            self.segments[mark].update(raw[8 * b : 8 * e] for b, e in zip(begin[which].tolist(), cut[which].tolist()))

    def _pair(self, kind: str, keys: np.ndarray) -> None:
        parts = self.pairs[kind]
        parts.append(np.unique(keys, return_counts=True))
        if len(parts) > 24:
            self.pairs[kind] = [_merge(parts)]

    def rows(self) -> Iterator[pd.DataFrame]:
        words = np.array(self.words, object)
        at = np.flatnonzero(self.uni)
        at = at[at > 3]
        yield _frame("w", words[at], "", self.uni[at])
        for kind, parts in self.pairs.items():
            if parts:
                keys, n = _merge(parts)
                yield _frame(kind, words[keys >> 32], words[keys & 0xFFFFFFFF], n)
        for mark, found in self.segments.items():
            whole = [(ids, n) for k, n in found.items() if (ids := np.frombuffer(k, np.int64)).min() > self.BROKEN]
            yield _frame("g", [" ".join(words[ids]) for ids, _ in whole], mark, [n for _, n in whole])
        if self.asked:
            yield _frame("d", np.array(sorted(self.asked), object), "", 1)
        if self.sections:
            stems = list(self.sections)
            yield _frame("s", np.array([x[0] for x in stems], object), np.array([x[1] for x in stems], object), np.fromiter(self.sections.values(), np.int64))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    n = np.concatenate([c for _, c in parts])
    u, inverse = np.unique(keys, return_inverse=True)
    return u, np.bincount(inverse, weights=n).astype(np.int64)


def _frame(kind: str, a, b, n) -> pd.DataFrame:
    return pd.DataFrame({"kind": kind, "a": a, "b": b, "n": n})


def count_all(units: DataFrame, text: str, section: str, unit_type: str) -> DataFrame:
    """kind, a, b, n over all texts: words (w), neighbours (p1), neighbours but one
    (p2), short segments of texts that are no headings (g; b 'half' where half a word stands before), and section names
    without and with a number at their end (s, b '' or '#'), and the words to look up
    where lines end in a hyphen (d)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        c = _Counts()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t and _HANGING.search(t):
                    c.asked.update(halves_met(t))
            body = [t for t, u in zip(b.column(0).to_pylist(), b.column(2).to_pylist()) if t and u != "heading"]
            c.add(body)
            c.add([t for t, u in zip(b.column(0).to_pylist(), b.column(2).to_pylist()) if t and u == "heading"], titles=True)
            names = Counter(b.column(1).to_pylist())
            c.add([s for s in names if s], titles=True)
            for s, n in names.items():
                if s:
                    c.asked.update(halves_met(s))
                if s and "\n" not in s and "  " not in s:
                    m = _TAIL_PAGE.match(s.strip())
                    c.sections[(m[1].lower(), "#") if m else (s.strip().lower(), "")] += n
        yield from c.rows()

    def as_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in run(batches):
            if len(f):
                yield pa.RecordBatch.from_pandas(f, preserve_index=False, schema=pa.schema([("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())]))

    rows = units.select(text, section, unit_type).mapInArrow(as_arrow, "kind string, a string, b string, n long")
    return rows.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


# --- vectors ------------------------------------------------------------------


class Vectors:
    """Learned vectors: ``w`` of words, ``c`` of contexts, by row; ``mean_w`` and
    ``mean_c`` are those of the average word, which every comparison is made against."""

    def __init__(self, words: list[str], w: np.ndarray, c: np.ndarray, mean_w: np.ndarray, mean_c: np.ndarray):
        self.number = {x: i for i, x in enumerate(words)}
        self.w, self.c, self.mean_w, self.mean_c = w, c, mean_w, mean_c

    def row(self, word: str) -> int:
        i = self.number.get(word)
        return len(self.number) + zlib.crc32(word.encode("utf-8", "surrogatepass")) % SHARED_ROWS if i is None else i


def skip_gram(counts: DataFrame) -> Vectors:
    """Vectors trained with negative sampling on all counted pairs of neighbours. The
    VECTOR_WORDS most frequent words have rows of their own, others share rows by
    hash; so the vectors have a fixed greatest size and no pair is left out. Each
    round hands them to the tasks; a task updates the words it holds and its own copy
    of the context vectors, whose changes are averaged."""
    spark = counts.sparkSession
    top = counts.where("kind = 'w'").orderBy(F.desc("n"), "a").limit(VECTOR_WORDS).select("a", "n").toPandas()
    words, v = top["a"].tolist(), len(top) + SHARED_ROWS
    rng = np.random.default_rng(7)
    # small at first, so that what the text doesn't tell apart stays near the average word
    w, c = rng.normal(0, 0.1 / DIMS**0.5, (v, DIMS)).astype(np.float32), np.zeros((v, DIMS), np.float32)
    out = Vectors(words, w, c, np.zeros(DIMS), np.zeros(DIMS))
    if len(words) < 3:
        return out
    shared = spark.sparkContext.broadcast(out)

    @F.pandas_udf("int")
    def as_row(s: pd.Series) -> pd.Series:
        row = shared.value.row
        return pd.Series([row(x) for x in s], dtype="int32")

    freq = np.zeros(v)
    rest = counts.where("kind = 'w'").groupBy(as_row("a").alias("x")).agg(F.sum("n").alias("n")).toPandas()
    freq[rest["x"].to_numpy()] = rest["n"].to_numpy(float)
    noise = freq**0.75 / (freq**0.75).sum()
    both = counts.where("kind in ('p1', 'p2')").select(as_row("a").alias("x"), as_row("b").alias("y"), "n")
    both = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"), "n")).groupBy("x", "y").agg(F.sum("n").alias("n"))
    tasks = max(1, min(spark.sparkContext.defaultParallelism, len(words) // 1000))
    pairs = settle(both.repartition(tasks, "x"), "pairs")
    for epoch in range(EPOCHS):
        state = spark.sparkContext.broadcast((w, c, np.cumsum(noise)))

        def run(frames: Iterator[pd.DataFrame], state=state, epoch=epoch) -> Iterator[pd.DataFrame]:
            w0, c0, cum = state.value
            w1, c1 = w0.copy(), c0.copy()
            f = pd.concat(list(frames) or [pd.DataFrame({"x": [], "y": [], "n": []})]).sort_values(["x", "y"])
            x, y, n = f["x"].to_numpy(np.int64), f["y"].to_numpy(np.int64), f["n"].to_numpy(float)
            weight = np.minimum(1.0, (n / 50.0) ** 0.75).astype(np.float32)
            rng = np.random.default_rng([1000 + epoch, len(x)])
            passes = max(PASSES, -(-LEAST_STEPS // max(1, -(-len(x) // BATCH))))
            for k in range(passes if len(x) else 0):
                rate = 0.25 * (1 - (epoch * passes + k) / (EPOCHS * passes)) + 0.02
                order = rng.permutation(len(x))
                for at in range(0, len(x), BATCH):
                    i = order[at : at + BATCH]
                    z = np.unique(np.minimum(np.searchsorted(cum, rng.random(DRAWN)), len(cum) - 1))
                    step(w1, c1, x[i], y[i], z, weight[i], rate)
            ids = np.unique(x)
            yield pd.DataFrame({"kind": 0, "i": ids, "v": list(w1[ids].astype(float))})
            touched = np.flatnonzero((c1 != c0).any(1))
            yield pd.DataFrame({"kind": 1, "i": touched, "v": list((c1 - c0)[touched].astype(float))})

        got = pairs.mapInPandas(run, "kind int, i long, v array<double>").toPandas()
        part = got[got["kind"] == 0]
        if len(part):
            w = w.copy()
            w[part["i"].to_numpy()] = np.array(part["v"].tolist())
        part = got[got["kind"] == 1]
        if len(part):
            delta, times = np.zeros_like(c), np.zeros((v, 1), np.float32)
            np.add.at(delta, part["i"].to_numpy(), np.array(part["v"].tolist(), np.float32))
            np.add.at(times, part["i"].to_numpy(), 1.0)
            c = c + delta / np.maximum(times, 1.0)
    return Vectors(words, w, c, (freq / freq.sum()) @ w, noise @ c)


def step(w, c, x, y, z, weight, rate: float) -> None:
    """One gradient step for a batch of pairs: sigmoid(w_x . c_y) towards 1, and towards 0
    with the drawn contexts ``z``, which all pairs of the batch share."""
    a, b, d = w[x], c[y], c[z]
    near = (rate * weight * (1 - _sigmoid((a * b).sum(1))))[:, None]
    far = -(rate * NEGATIVES / len(z)) * weight[:, None] * _sigmoid(a @ d.T)
    _spread(w, x, near * b + far @ d)
    _spread(c, y, near * a)
    c[z] += _held(far.T @ a / np.sqrt(max(1.0, NEGATIVES * len(x) / len(z))))


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -15, 15)))


def _spread(target: np.ndarray, at: np.ndarray, change: np.ndarray) -> None:
    """Add the changes of each row, damped where many meet."""
    order = np.argsort(at, kind="stable")
    rows = at[order]
    begin = np.flatnonzero(np.diff(rows, prepend=rows[0] - 1))
    target[rows[begin]] += _held(np.add.reduceat(change[order], begin) / np.sqrt(np.diff(np.r_[begin, len(rows)]))[:, None])


def _held(change: np.ndarray) -> np.ndarray:
    """Changes of a row no longer than MOST_CHANGE, so that no vector runs away."""
    return change * np.minimum(1.0, MOST_CHANGE / np.maximum(np.linalg.norm(change, axis=1, keepdims=True), 1e-9))


# --- links --------------------------------------------------------------------


def printed_forms(word: str) -> dict[str, int]:
    """What may have been printed where ``word`` is read, with the number of glyph
    changes: 1, and for longer words 2."""
    seen: dict[str, int] = {word: 0}
    edge = {word}
    for k in range(1, 3 if len(word) > 5 else 2):
        edge = {x[:i] + right + x[i + len(wrong) :] for x in edge for wrong, right in GLYPHS for i in _places(x, wrong)} - seen.keys()
        seen |= dict.fromkeys(edge, k)
    del seen[word]
    return seen


def _places(s: str, part: str) -> Iterator[int]:
    i = s.find(part)
    while i >= 0:
        yield i
        i = s.find(part, i + 1)


def glyph_edits(wrong: str, right: str, most: int = 2) -> int | None:
    """How many glyph changes, at most ``most``, lead from ``wrong`` to ``right``; None if
    more. The same as looking ``right`` up in all printed forms, but only changes near
    the first difference are tried, so that a word of any length is quick."""
    if wrong == right:
        return 0
    if not most or abs(len(wrong) - len(right)) > 2 * most:
        return None
    m = next((i for i, (p, q) in enumerate(zip(wrong, right)) if p != q), min(len(wrong), len(right)))
    best = None
    for i in range(max(0, m - 2), min(len(wrong), m + 3)):
        for a, b in GLYPHS:
            if wrong.startswith(a, i):
                k = glyph_edits(wrong[:i] + b + wrong[i + len(a) :], right, most - 1)
                if k is not None and (best is None or k + 1 < best):
                    best = k + 1
    return best


def _candidates(vocab: DataFrame) -> DataFrame:
    """wrong, n_wrong, right, n_right, edits: words with a printed form that is a word.
    Both sides meet by a shuffle join: at the whole form where the word has at most
    FORM_LETTERS letters, so that forms are bounded; longer ones at the first
    KEY_LETTERS of the forms of their beginning, checked in full."""

    @F.pandas_udf("array<struct<word:string,edits:int>>")
    def forms(s: pd.Series) -> pd.Series:
        return pd.Series([[{"word": f, "edits": e} for f, e in sorted(printed_forms(x).items())] for x in s], dtype=object)

    @F.pandas_udf("array<string>")
    def keys(s: pd.Series) -> pd.Series:
        return pd.Series([sorted({f[:KEY_LETTERS] for f in (*printed_forms(x[:FORM_LETTERS]), x)}) for x in s], dtype=object)

    @F.pandas_udf("int")
    def edits(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([glyph_edits(x, y) for x, y in zip(a, b)], dtype="Int32")

    right = vocab.where((F.length("word") >= MIN_LENGTH) & F.col("word").rlike(r"^\p{L}+$")).select(F.col("word").alias("right"), F.col("n").alias("n_right"))
    rare = vocab.where((F.length("word") >= MIN_LENGTH - 1) & F.col("word").rlike(r"\p{L}{2}")).select(F.col("word").alias("wrong"), F.col("n").alias("n_wrong"))
    short = rare.where(F.length("wrong") <= FORM_LETTERS).select("wrong", "n_wrong", F.explode(forms("wrong")).alias("f")).select("wrong", "n_wrong", F.col("f.word").alias("right"), F.col("f.edits").alias("edits"))
    short = short.join(right.hint("merge"), "right")
    long = rare.where(F.length("wrong") > FORM_LETTERS).select("wrong", "n_wrong", F.explode(keys("wrong")).alias("key"))
    long = long.join(right.where(F.length("right") >= KEY_LETTERS).withColumn("key", F.substring("right", 1, KEY_LETTERS)).hint("merge"), "key")
    long = long.where((F.col("n_right") > F.col("n_wrong")) & (F.abs(F.length("wrong") - F.length("right")) <= 4)).select("wrong", "n_wrong", "right", "n_right").distinct().withColumn("edits", edits("wrong", "right"))
    return short.unionByName(long.where("edits > 0"))


def link_words(counts: DataFrame, vectors: Vectors) -> DataFrame:
    """wrong, right, edits, n_wrong, n_right, odd, sim for every rare word with a
    printed form that is FREQUENCY_RATIO times as frequent (ODD_RATIO for words of a
    shape that no word has), if the vectors agree as much as the rest of the evidence
    leaves open. ``sim`` is the cosine of the learned vector of ``right`` (composed,
    if it has no row of its own) and the composed one of ``wrong``, both against the
    average word; null where a word has no neighbours, as in a title: then the counts
    decide, at LONE_RATIO."""
    spark = counts.sparkSession
    odd = F.col("wrong").rlike(_ODD.pattern)
    links = _candidates(counts.where("kind = 'w'").select(F.col("a").alias("word"), "n")).withColumn("odd", odd)
    links = settle(links.where(F.col("n_right") >= F.when(F.col("odd"), F.lit(ODD_RATIO)).otherwise(F.lit(FREQUENCY_RATIO)) * F.col("n_wrong")), "links")
    if len(vectors.number) < 3:
        return links.limit(0).select("wrong", "right", "edits", "n_wrong", "n_right", "odd", F.lit(0.0).alias("sim"))
    shared = spark.sparkContext.broadcast(vectors)

    @F.pandas_udf("boolean")
    def has_row(s: pd.Series) -> pd.Series:
        return s.isin(shared.value.number.keys())

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the neighbours' context vectors, each weighted by the root of its count."""
        v = shared.value
        c = v.c - v.mean_c
        for b in batches:
            words, x = np.unique(np.array(b.column(0).to_pylist(), object), return_inverse=True)
            n = b.column(2).to_numpy().astype(float)
            if not len(n):
                continue
            root = np.sqrt(n)
            total = np.zeros((len(words), DIMS))
            np.add.at(total, x, c[[v.row(y) for y in b.column(1).to_pylist()]] * root[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(words.tolist(), pa.string()), pa.array(np.bincount(x, n)), pa.array(np.bincount(x, root)), *[pa.array(total[:, i]) for i in range(DIMS)]], names=names)

    names = ["x", "m", "roots", *[f"d{i}" for i in range(DIMS)]]
    without = links.select("right").distinct().where(~has_row("right"))
    involved = links.select(F.col("wrong").alias("x")).unionByName(without.select(F.col("right").alias("x"))).distinct()
    near = counts.where("kind in ('p1', 'p2')")
    near = near.select(F.col("a").alias("x"), F.col("b").alias("y"), "n").unionByName(near.select(F.col("b").alias("x"), F.col("a").alias("y"), "n"))
    near = near.join(involved.hint("merge"), "x", "left_semi").select("x", "y", "n")
    sums = near.mapInArrow(compose, "x string, " + ", ".join(f"{c} double" for c in names[1:])).groupBy("x").agg(*[F.sum(c).alias(c) for c in names[1:]])
    vec = settle(sums.select("x", "m", F.array(*[F.col(c) / F.col("roots") for c in names[3:]]).alias("v")), "vec")

    @F.pandas_udf("struct<dot:double,sizes:double>")
    def compare(right: pd.Series, va: pd.Series, vc: pd.Series) -> pd.DataFrame:
        """Of the composed vector of the wrong word and the learned one of the right word."""
        v = shared.value
        out = []
        for r, a, b in zip(right, va, vc):
            b = v.w[v.number[r]] - v.mean_w if r in v.number else b
            out.append((None, None) if a is None or b is None else (float(np.dot(a, b)), float(np.linalg.norm(a) * np.linalg.norm(b))))
        return pd.DataFrame(out, columns=["dot", "sizes"])

    out = links.join(vec.select(F.col("x").alias("wrong"), F.col("v").alias("va"), "m").hint("merge"), "wrong", "left")
    out = out.join(vec.select(F.col("x").alias("right"), F.col("v").alias("vc")).hint("merge"), "right", "left").withColumn("z", compare("right", "va", "vc"))
    out = out.withColumn("dot", F.col("z.dot")).withColumn("sizes", F.col("z.sizes")).withColumn("sim", F.col("dot") / F.nullif("sizes", F.lit(0.0)))
    ratio = F.col("n_right") / F.col("n_wrong")
    accent = ~F.col("wrong").rlike(r"^[\x00-\x7F]+$") & F.col("right").rlike(r"^[\x00-\x7F]+$")
    wanted = F.greatest(F.lit(SIM_LEAST), SIM_PLAIN - SIM_SLOPE * F.log2(ratio / SIM_AT)) - F.when(F.col("odd") | accent, SIM_ODD).otherwise(0.0) - SIM_NOISE / F.sqrt("m")
    keep = F.when(F.col("sim").isNull(), F.col("odd") | (ratio >= LONE_RATIO)).otherwise(F.col("dot") >= wanted * F.col("sizes") - DOT_SLACK)
    return out.where(keep).select("wrong", "right", "edits", "n_wrong", "n_right", "odd", "sim", "m", "dot", "sizes")


def find_furniture(counts: DataFrame, links: DataFrame) -> DataFrame:
    """segment, n, share: short segments that occur as whole segments nearly always.
    Those with a misread word are left out; they are compared when corrected."""
    seg = counts.where("kind = 'g'").groupBy(F.col("a").alias("segment")).agg(F.sum(F.when(F.col("b") == "", F.col("n")).otherwise(0)).alias("own"), F.sum("n").alias("n"))
    seg = seg.where(F.col("own") >= FURNITURE_COUNT).select("segment", "n").where(F.col("segment").rlike(r"\p{L}{3}"))
    t = F.split("segment", " ")
    two = F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.struct(F.element_at(t, i).alias("a"), F.element_at(t, i + 1).alias("b")))
    pairs = seg.where(F.size(t) > 1).select("segment", "n", F.explode(two).alias("p")).select("segment", "n", "p.a", "p.b")
    p1 = counts.where("kind = 'p1'").select("a", "b", F.col("n").alias("n_pair"))
    whole = pairs.join(p1.hint("merge"), ["a", "b"], "left").groupBy("segment", "n").agg(F.min(F.coalesce("n_pair", F.lit(0))).alias("least"))
    ones = seg.where(F.size(t) == 1).join(counts.where("kind = 'w'").select(F.col("a").alias("segment"), F.col("n").alias("least")).hint("merge"), "segment")
    both = whole.unionByName(ones.select("segment", "n", "least")).withColumn("share", F.col("n") / F.greatest("n", "least"))
    kept = both.where(F.col("share") >= FURNITURE_SHARE).select("segment", "n", "share")
    misread = kept.select("segment", F.explode(F.split("segment", " ")).alias("wrong")).join(links.select("wrong").distinct().hint("merge"), "wrong", "left_semi")
    return kept.join(misread.select("segment").distinct().hint("merge"), "segment", "left_anti")


def page_stems(counts: DataFrame) -> DataFrame:
    """Section names that occur with a number at their end, but more often without: there it is a page's."""
    s = counts.where("kind = 's'").groupBy("a").agg(F.sum(F.when(F.col("b") == "", F.col("n")).otherwise(0)).alias("bare"), F.sum(F.when(F.col("b") == "#", F.col("n")).otherwise(0)).alias("numbered"))
    return s.where("numbered > 0 and bare >= numbered").select(F.col("a").alias("stem"))


# --- repair -------------------------------------------------------------------


class Repairer:
    """Repairs one field at a time, given what the counting found."""

    def __init__(self, links: dict[str, list[str]], furniture: frozenset[str], stems: frozenset[str], known: frozenset[str] | np.ndarray, vectors: Vectors | None):
        self.vectors = vectors
        self.use(links, known, furniture, stems)

    def use(self, links: dict[str, list[str]], known: frozenset[str] | np.ndarray, furniture: frozenset[str], stems: frozenset[str]) -> None:
        """Take what was found of all words and segments of the fields to come."""
        self.links, self.known, self.furniture, self.stems = links, known, furniture, stems
        begin = {x.split(" ")[0] for x in furniture}
        # first words of furniture, as printed and as misread, for a quick look before the exact one
        self.first = begin | {w for w, rights in links.items() if rights[0] in begin}

    def segment_key(self, s: str) -> str:
        out = [self._header_word(t) for t in _WORD.findall(s.lower())]
        while out and out[-1] in HEADER_TAILS:
            out.pop()
        if len(out) > SEGMENT_WORDS or (len(out) == 1 and out[0] == "#"):
            return ""
        return " ".join(out)

    def _header_word(self, t: str) -> str:
        if t.isdigit():
            return "#"
        if t in self.links:
            return self.links[t][0]
        # words too short to be linked
        if len(t) < MIN_LENGTH and not (t.isascii() and t.isalpha()):
            return next((x for x in printed_forms(t) if x in HEADER_TAILS), t.translate(_ONE_GLYPH))
        return t

    def _all_furniture(self, s: str) -> bool:
        first = _WORD.search(s)
        if not first or first[0].lower() not in self.first and first[0].isascii() and first[0].isalpha():
            return False
        parts = [x.strip(" /·") for x in _SEGMENTS.split(f" {s} ")]
        return all(self.is_furniture(x) for x in parts if x) and any(parts)

    def is_furniture(self, s: str) -> bool:
        return bool(s) and (k := self.segment_key(s)) != "" and k in self.furniture

    def repair(self, text: str | None, is_title: bool) -> tuple[str | None, list[str]]:
        """(continuous text, kinds of noise met)."""
        if not text:
            return text, []
        found: set[str] = set()
        lines = _lines(text)
        if len(lines) == 1 and not is_title and "  " not in lines[0]:
            return self._correct(lines[0], found), sorted(found)
        # pieces of text with the number of the line they stand on
        pieces: list[tuple[int, str]] = []
        width = max(map(len, lines), default=0)
        for i, line in enumerate(lines):
            if len(line) < 20 and len(lines) > 1 and _PAGE.fullmatch(line) and self._stands_alone(lines, i, width):
                found.add("pageno")
            elif "  " in line:
                parts = re.split(r"  +", line)
                gone = [self._all_furniture(x) for x in parts]
                if any(gone):
                    found.add("header")
                pieces += [(i, x) for x, g in zip(parts, gone) if x and not g and not (any(gone) and x in "·/")]
            elif len(lines) > 1 and self._all_furniture(line):
                found.add("header")
            else:
                pieces.append((i, line))
        if is_title and pieces:
            pieces = self._title_page(pieces, found)
        out, last = "", -1
        for i, piece in pieces:
            if out and i != last and out[-1] in _DIVIDING and (how := self._divided(out, piece)):
                found.add("hyphen")
                out = (out.rstrip(HYPHENS + SOFT + " ") if how == "join" else out) + piece
            else:
                out = f"{out} {piece}" if out else piece
            last = i
        return " ".join(self._correct(out, found).split()), sorted(found)

    def _stands_alone(self, lines: list[str], i: int, width: int) -> bool:
        """Whether a line of a page number is no part of the wrapped text: either it
        would have fit on the line before, or the word after it on its line."""
        if i == 0 or not lines[i].isdigit():
            return True
        if i + 1 < len(lines):
            return len(lines[i]) + 1 + len(lines[i + 1].split(" ")[0]) <= width
        return len(lines[i - 1]) + 1 + len(lines[i]) <= width or lines[i - 1][-1] in ".!?:;)]" or self._all_furniture(lines[i - 1])

    def _title_page(self, pieces: list[tuple[int, str]], found: set[str]) -> list[tuple[int, str]]:
        i, s = pieces[-1]
        m = _TAIL_PAGE.match(s)
        if m and (not m[2].isdigit() or self._stem(m[1])):
            found.add("pageno")
            pieces = [*pieces[:-1], (i, m[1])]
        i, s = pieces[0]
        m = _HEAD_PAGE.match(s)
        if m and (not m[1].isdigit() or self._stem(m[2])):
            found.add("pageno")
            pieces = [(i, m[2]), *pieces[1:]]
        return pieces

    def _stem(self, s: str) -> bool:
        return self.stem_key(s) in self.stems

    def stem_key(self, s: str) -> str:
        return " ".join(self.links[t][0] if t in self.links else t for t in s.lower().split())

    def marks_met(self, text: str | None, is_title: bool) -> set[str]:
        """Every segment, and every stem after \x02, that repair() may look up in this field."""
        out: set[str] = set()
        if not text:
            return out
        for line in _lines(text):
            for piece in re.split(r"  +", line):
                out.update(self.segment_key(x.strip(" /·")) for x in _SEGMENTS.split(f" {piece} "))
                if is_title:
                    tail = m[1] if (m := _TAIL_PAGE.match(piece)) else piece
                    heads = [m[2] for x in (piece, tail) if (m := _HEAD_PAGE.match(x))]
                    out.update("\x02" + self.stem_key(x) for x in (tail, *heads))
        return out - {""}

    def _divided(self, left: str, right: str) -> str:
        """'join' or 'keep' (the hyphen) if a word or name goes on from ``left`` to ``right``; else ''."""
        mark = left[-1]
        if mark in SOFT:
            return "join" if len(left) > 1 and left[-2].isalnum() and right[0].isalnum() else ""
        if mark not in HYPHENS or len(left) < 2 or not (left[-2].isalnum() or left[-2] in "'′)]*"):
            return ""
        token = left.rsplit(" ", 1)[-1]
        first = _WORD.match(right)
        word = first[0] if first else ""
        if not word and right[0] not in "([":
            return ""
        half = re.split(r"[^\w]", token[:-1])[-1].lower()
        if word.lower() in AFTER_HANGING and right[len(word) : len(word) + 1] in ("", " ", ",") and not self._known(half + word.lower()):
            return ""
        if _CHARGED.search(token) and not (word[:1].isupper() and token[-2] not in ")]"):
            tail = token[:-1]
            if tail[-1] in ")]" or re.search(r"[\])]\d+$", tail) or word[:1].islower():
                return ""
        if not half.isalpha() or len(half) < 2 or word[:1].isdigit() or word[:1].isupper() and not half.isupper() and left[-2].islower():
            return "keep"
        word = word.lower()
        return "keep" if not self._known(half + word) and self._known(half) and self._known(word) else "join"

    def _known(self, word: str) -> bool:
        return (word in self.known if isinstance(self.known, frozenset) else bool(self.known[_bucket(word)])) or word in self.links

    def _correct(self, s: str, found: set[str]) -> str:
        links = self.links
        if "!" not in s and links.keys().isdisjoint(_words_of(s)):
            return s
        low = [t.lower() for t in _WORD.findall(s)]
        if links.keys().isdisjoint(low):
            return s
        found.add("chars")
        out, pos = [], 0
        for i, m in enumerate(_WORD.finditer(s)):
            options = links.get(low[i])
            if not options:
                continue
            right = options[0] if len(options) == 1 else self._best(options, low[max(0, i - WINDOW) : i] + low[i + 1 : i + 1 + WINDOW])
            out.append(s[pos : m.start()] + _like(right, m[0]))
            pos = m.end()
        return "".join(out) + s[pos:]

    def _best(self, options: list[str], around: list[str]) -> str:
        """The option that goes best with the words around, by the vectors: of the learned
        vectors, the one nearest to the composed one of the words around."""
        v = self.vectors
        if v is None or not around:
            return options[0]
        mean = v.c[[v.row(x) for x in around]].mean(0) - v.mean_c
        size = np.linalg.norm(mean)

        def fit(x: str) -> float:
            own = v.w[v.row(x)] - v.mean_w
            return float(own @ mean) / max(1e-9, float(np.linalg.norm(own)) * size)

        return max(options, key=lambda x: (fit(x), -options.index(x)))


def _lines(text: str) -> list[str]:
    return [x for x in map(str.strip, _LINES.split(text)) if x] if _LINES.search(text) else [text.strip()]


def words_met(text: str | None, is_title: bool) -> set[str]:
    """Every word that repair() may look up in this field, whatever is furniture: those
    of each piece, and what the end of a piece makes with the begin of a later one
    if all between may go."""
    if not text:
        return set()
    out: set[str] = set(halves_met(text))
    for line in _lines(text):
        low = line.lower()
        out.update(_WORD.findall(low), (t.lower() for t in _WORD.findall(line)))
        if is_title:
            out.update(low.split())
    return out


def halves_met(text: str) -> Iterator[str]:
    """The words that repair() may make or ask for where a piece goes on from an earlier
    one: both halves and what they make together."""
    open_: set[str] = set()  # ends of pieces before a hyphen that the next piece kept may go on from
    lines = _lines(text)
    if len(lines) == 1:
        return
    for line in lines:
        for piece in re.split(r"  +", line) if "  " in line else (line,):
            bare = piece.rstrip(HYPHENS + SOFT + " ") if piece and piece[-1] in _DIVIDING else piece
            if not open_ and bare is piece:
                continue
            low = piece.lower()
            head, tail = _RUN_HEAD.match(low)[0], _RUN_TAIL.search(bare.lower())[0]
            ends = {tail} if bare is not piece else set()
            for t in open_:
                half = re.split(r"[^\w]", t)[-1]
                word = m[0] if (m := _WORD.match(head)) else ""
                yield from _WORD.findall(t + head)
                yield from (half, word, half + word)
                if ends and len(head) == len(bare):
                    ends.add(t + head)
            open_ = ends | open_ if open_ and _may_go(low) else ends


_HANGING = re.compile(rf"[{HYPHENS}{SOFT}]\s")
_RUN_HEAD, _RUN_TAIL = re.compile(r"[\w!]*"), re.compile(r"[\w!]*$")


def _may_go(low: str) -> bool:
    """Whether a piece may be furniture or a page number, however it is misread."""
    for part in _SEGMENTS.split(f" {low} "):
        t = _WORD.findall(part)
        while t and len(t[-1]) <= LONGEST_TAIL:
            t.pop()
        if len(t) > SEGMENT_WORDS:
            return False
    return True


def _like(word: str, model: str) -> str:
    """``word`` with the letter case of ``model``."""
    letters = [x for x in model if x.isalpha()]
    if len(letters) > 1 and all(x.isupper() for x in letters):
        return word.upper()
    return word[0].upper() + word[1:] if model[0].isupper() else word


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % KNOWN_BUCKETS


def known_words(counts: DataFrame) -> DataFrame:
    """word: those that are asked for where lines end in a hyphen and occur often enough, exactly."""
    words = counts.where("kind = 'w'")
    total = words.agg(F.sum("n")).first()[0] or 0
    often = words.where(F.col("n") >= max(KNOWN_COUNT, total * KNOWN_SHARE)).select(F.col("a").alias("word"))
    return counts.where("kind = 'd'").select(F.col("a").alias("word")).join(often.hint("merge"), "word", "left_semi")


def repair_units(units: DataFrame, id_col: str = "unit_id", text: str = "text", section: str = "section", unit_type: str = "unit_type", max_links: int = MAX_BROADCAST) -> DataFrame:
    """id_col, field_name ('text', 'section'), repaired, defects for each row and field.

    ``defects`` holds 'hyphen', 'chars', 'header', 'pageno' as they were met, in
    that order of the alphabet; ``repaired`` is continuous text. Null stays null and
    empty stays empty, without defects. A heading's text is treated as a section
    name. Rows are treated alone, repeated rows alike; texts are taken whole; further
    columns have no influence. An empty table gives none.
    """
    spark = units.sparkSession
    base = units.select(F.col(id_col).alias("__id"), F.col(text).alias("text"), F.col(section).alias("section"), F.col(unit_type).alias("unit_type"))
    counts = settle(count_all(base, "text", "section", "unit_type"), "counts")
    vectors = skip_gram(counts)
    links = settle(link_words(counts, vectors), "linked")
    furniture = settle(find_furniture(counts, links).select("segment").unionByName(page_stems(counts).select(F.concat(F.lit("\x02"), "stem").alias("segment"))), "furniture")
    known = settle(known_words(counts), "known")
    by_row = max(links.count(), known.count(), furniture.count()) > max_links
    if not by_row:
        sure, marks = frozenset(r[0] for r in known.collect()), [r[0] for r in furniture.collect()]
        table = _link_table([tuple(r) for r in links.select("wrong", "right", "edits", "n_right").collect()])
    else:  # too many to hand to every task: each row gets the links of its own words, and the marks of its own segments, by joins
        table, sure, marks = {}, frozenset(), []
        # rows of one hash share their links, of which each looks up those of its own words only
        # a known word is a row without a correction
        facts = links.select("wrong", "right", "edits", "n_right").unionByName(known.select(F.col("word").alias("wrong")), allowMissingColumns=True)
        base = base.withColumn("key", F.xxhash64("text", "section", "unit_type"))
        own = settle(_own_links(base, facts), "own")
        seen = _own_marks(base.join(own.hint("merge"), "key", "left"), furniture)
        base = base.join(own.hint("merge"), "key", "left").join(seen.hint("merge"), "key", "left")
    heads, stems = _heads_stems(marks)
    shared = spark.sparkContext.broadcast((table, heads, stems, sure, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixer = Repairer(*shared.value)
        titles: dict[str, tuple[str, list[str]]] = {}
        for b in batches:
            ids, texts, sections, kinds = (b.column(i) for i in range(4))
            names, fixed, kinds_met, at = [], [], [], []
            own, seen = (b.column(4).to_pylist(), b.column(5).to_pylist()) if by_row else (None, None)
            for i, (t, s, k) in enumerate(zip(texts.to_pylist(), sections.to_pylist(), kinds.to_pylist())):
                if own is not None:
                    fixer.use(*_facts(own[i]), *_heads_stems(seen[i] or []))
                    titles = {}
                for name, value, title in (("text", t, k == "heading"), ("section", s, True)):
                    if title and value:
                        if value not in titles:
                            titles[value] = fixer.repair(value, True)
                        done = titles[value]
                    else:
                        done = fixer.repair(value, title)
                    at.append(i)
                    names.append(name)
                    fixed.append(done[0])
                    kinds_met.append(done[1])
                if len(titles) > 100_000:
                    titles = {}
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(fixed, pa.string()), pa.array(kinds_met, pa.list_(pa.string()))], names=[id_col, "field_name", "repaired", "defects"])

    schema = T.StructType([T.StructField(id_col, base.schema["__id"].dataType), *T.StructType.fromDDL("field_name string, repaired string, defects array<string>").fields])
    return base.select("__id", "text", "section", "unit_type", *(["own", "marks"] if by_row else [])).mapInArrow(run, schema)


def _link_table(rows: list[tuple[str, str, int, int]]) -> dict[str, list[str]]:
    """wrong -> corrections, those of fewest edits only, the most frequent first."""
    out: dict[str, list[tuple[int, int, str]]] = {}
    for wrong, right, edits, n in rows:
        out.setdefault(wrong, []).append((edits, -n, right))
    return {k: [x[2] for x in sorted(v) if x[0] == min(v)[0]] for k, v in out.items()}


def _own_links(base: DataFrame, facts: DataFrame) -> DataFrame:
    """key, own: the facts on all words that repair() may look up in the rows of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, words = [], []
            for key, t, s, k in zip(*(b.column(i).to_pylist() for i in range(4))):
                met = words_met(t, k == "heading") | words_met(s, True)
                met = [w for w in met if w and not w.isdigit()]
                keys += [key] * len(met)
                words += met
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.string())], names=["key", "wrong"])

    words = base.select("key", "text", "section", "unit_type").mapInArrow(run, "key long, wrong string").distinct()
    met = words.join(facts.hint("merge"), "wrong")
    return met.groupBy("key").agg(F.collect_set(F.struct("wrong", "right", "edits", "n_right")).alias("own"))


def _facts(own: list[dict] | None) -> tuple[dict[str, list[str]], frozenset[str]]:
    """Links and known words of a row."""
    rows = own or []
    return _link_table([(x["wrong"], x["right"], x["edits"], x["n_right"]) for x in rows if x["right"] is not None]), frozenset(x["wrong"] for x in rows if x["right"] is None)


def _heads_stems(marks: list[str]) -> tuple[frozenset[str], frozenset[str]]:
    return frozenset(x for x in marks if x[0] != "\x02"), frozenset(x[1:] for x in marks if x[0] == "\x02")


def _own_marks(base: DataFrame, furniture: DataFrame) -> DataFrame:
    """key, marks: furniture and page stems among all segments that repair() may look up in the rows of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixer = Repairer({}, frozenset(), frozenset(), frozenset(), None)
        for b in batches:
            keys, segments = [], []
            for key, t, s, k, own in zip(*(b.column(i).to_pylist() for i in range(5))):
                fixer.use(*_facts(own), frozenset(), frozenset())
                met = fixer.marks_met(t, k == "heading") | fixer.marks_met(s, True)
                keys += [key] * len(met)
                segments += met
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(segments, pa.string())], names=["key", "segment"])

    met = base.select("key", "text", "section", "unit_type", "own").mapInArrow(run, "key long, segment string").distinct()
    return met.join(furniture.hint("merge"), "segment").groupBy("key").agg(F.collect_set("segment").alias("marks"))

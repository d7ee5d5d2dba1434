"""Reading level of each document (problem 10): regularised ordinal regression.

Features are read from whole texts: lexical diversity, word rarity, connectives,
a proxy of clause depth, and lengths. Texts are cut into words and sentences on
arrays of code points, many texts at once; a word is known by a 64-bit hash.
Rarity is log2(words of the corpus / uses of the word), from counts of all words
of all texts, and at most RARITY_BITS: no more than 2**RARITY_BITS words can be
more frequent than that, so the table of counts that is handed to the tasks has
a proven size at any vocabulary, and every other word is as rare as can be.
The regression (cumulative logits, one weight vector, ordered thresholds,
quadratic penalty) is fitted to the graded documents, at most MAX_GRADED of them
by hash, and its thresholds calibrate the score to their levels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle

#: Graded documents that the regression is fitted to, at most.
MAX_GRADED = 20_000
#: Rarity of the rarest words, in bits.
RARITY_BITS = 20
#: Characters that are cut into words at once, and distinct words a task remembers or counts before it hands them on.
SLICE_CHARS, MEMO_WORDS = 2_000_000, 1_000_000
PENALTY = 1e-2

# Connectives, subordinating words, and words of beginners' sentences.
CONNECTIVES = "however therefore thus hence moreover furthermore consequently nevertheless nonetheless notwithstanding thereby whereas although because since while consequently accordingly conversely instead likewise meanwhile otherwise similarly subsequently".split()
SUBORDINATORS = "which that whose whom who where when whether if unless until although though because since while whereas so before after as".split()
PRONOUNS = "i you he she it we they me him her us them my your his its our their".split()
EXCLAIMS = "wow oh look yes no yay hooray please".split()

_SYLLABLE = re.compile(r"[aeiouyäöüéèàáíóú]+")
_NOMINAL = ("tion", "tions", "ment", "ments", "ity", "ities", "ness", "ance", "ence")
# what a character is, as bits
_ALPHA, _SPACE, _STOP, _CLOSE, _LINE = 1, 2, 4, 8, 16
#: Marks that are counted, in this order, then digits and capital letters of ASCII.
_MARKS = [",", ";", "!", "([", "-"]


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """(bits of each code point, number of the mark it counts as; 0 for none)."""
    bits = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            bits[i] = _ALPHA
        elif c.isspace():
            bits[i] = _SPACE
    for c in ".!?":
        bits[ord(c)] |= _STOP
    for c in "\"')]":
        bits[ord(c)] |= _CLOSE
    bits[10] |= _LINE
    marks = np.zeros(0x110000, np.uint8)
    for k, group in enumerate(_MARKS, 1):
        for c in group:
            marks[ord(c)] = k
    marks[48:58], marks[65:91] = len(_MARKS) + 1, len(_MARKS) + 2
    return bits, marks


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


@cache
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def cut_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, first place, length, hash) of the words of a lower-case text: its runs of letters."""
    codes = _codes(text)
    alpha = (_kinds()[0][codes] & _ALPHA).astype(np.int8)
    step = np.diff(alpha, prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    size = end - start
    if not len(start):
        return codes, start, size, np.zeros(0, np.uint64)
    at = np.flatnonzero(alpha)
    first = np.r_[0, np.cumsum(size)[:-1]]
    place = at - np.repeat(start, size)
    with np.errstate(over="ignore"):
        power = _powers(1 << int(max(6, int(size.max()).bit_length())))
        h = np.add.reduceat(codes[at].astype(np.uint64) * power[place], first)
        return codes, start, size, _mixed(h + size.astype(np.uint64))


def word_hash(word: str) -> int:
    """The hash that cut_words gives a word."""
    return int(cut_words(word)[3][0])


FEATURES = [
    "word_len", "word_len_sd", "long7", "long10", "syllables", "poly", "sent_words", "sent_words_sd", "sent_q25", "sent_q75", "sent_max", "short_sent",
    "rarity", "rarity_q75", "rarity_q95", "rare_share", "sent_rarity_sd", "ttr100", "hapax", "connective", "subordinate", "commas", "depth", "semicolon", "passive",
    "pronoun", "exclaim", "digits", "brackets", "upper", "hyphen", "sent_len_word_len", "nominal",
]


def _slices(texts: list[str]) -> Iterator[list[int]]:
    """Numbers of the texts in runs of about SLICE_CHARS characters."""
    run: list[int] = []
    n = 0
    for i, t in enumerate(texts):
        run.append(i)
        n += len(t) + 1
        if n >= SLICE_CHARS:
            yield run
            run, n = [], 0
    if run:
        yield run


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(h, return_inverse=True)
    return u, np.bincount(inverse, weights=n, minlength=len(u)).astype(np.int64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in ascending order, how often each occurs); numbers sort faster than they hash."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[at], np.diff(np.r_[at, len(keys)])


def count_words(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in ascending order, rarity in bits) of the words that are less rare than
    RARITY_BITS. All words of all texts are counted; a task adds its own up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        have, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t]
            for part in _slices(texts):
                u, c = np.unique(cut_words("\n".join([texts[i] for i in part]).lower())[3], return_counts=True)
                have, n = _summed(np.r_[have, u], np.r_[n, c])
                if len(have) > MEMO_WORDS:
                    yield out(have, n)
                    have, n = have[:0], n[:0]
        yield out(have, n)

    counts = settle(docs.select(text_col).where(F.col(text_col).isNotNull()).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # at most 2**RARITY_BITS rows: each of these words makes up more than that part of all
    rows = counts.where(F.col("n") > total / 2**RARITY_BITS).toPandas()
    h, n = rows["h"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(float)
    order = np.argsort(h)
    return h[order], np.minimum(RARITY_BITS, np.log2((total + 1) / (n[order] + 1.0)))


class Reader:
    """Features of texts, given the table of rarities; it remembers the words it has met."""

    def __init__(self, table: tuple[np.ndarray, np.ndarray]):
        self.hashes, self.bits = table
        self._forget()

    def _forget(self) -> None:
        self.known, self.facts = np.zeros(0, np.uint64), np.zeros((0, 4))

    def _facts(self, u: np.ndarray, spelled) -> np.ndarray:
        """length, syllables, rarity and kind of words by hash; ``spelled(i)`` gives the i-th's letters."""
        at = np.searchsorted(self.known, u)
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != u) if len(self.known) else np.arange(len(u))
        if len(new):
            if len(self.known) + len(new) > MEMO_WORDS:
                self._forget()
                new = np.arange(len(u))
            words = [spelled(int(i)) for i in new]
            rare = np.full(len(new), float(RARITY_BITS))
            if len(self.hashes):
                p = np.minimum(np.searchsorted(self.hashes, u[new]), len(self.hashes) - 1)
                rare = np.where(self.hashes[p] == u[new], self.bits[p], rare)
            facts = np.array([(len(w), max(1, len(_SYLLABLE.findall(w))), r, sum((w in x) << k for k, x in enumerate(_SETS)) | w.endswith(_NOMINAL) << 4 | w.endswith("ed") << 5) for w, r in zip(words, rare)], float)
            known = np.r_[self.known, u[new]]
            order = np.argsort(known)
            self.known, self.facts = known[order], np.concatenate([self.facts, facts])[order]
            at = np.searchsorted(self.known, u)
        return self.facts[at]

    def features(self, texts: list[str]) -> np.ndarray:
        """A row of FEATURES for each text, zeros for one without words."""
        out = np.zeros((len(texts), len(FEATURES)))
        for part in _slices(texts):
            out[part] = self._read([texts[i] for i in part])
        return out

    def _read(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(FEATURES)))
        low = [t.lower() for t in texts]
        # texts are parted by a character that is no letter, blank or stop
        codes, start, size, h = cut_words("\0".join(low))
        if not len(start):
            return out
        kind = _kinds()[0][codes]
        ends = np.cumsum([len(t) + 1 for t in low])
        text_of = np.searchsorted(ends, start, "right")
        # a sentence ends at a blank after a stop and closing marks, and at an empty line
        place = np.arange(len(codes))
        before = lambda mask: np.r_[-1, np.maximum.accumulate(np.where(mask, place, -1))[:-1]]
        plain = before(kind & _CLOSE == 0)
        ended = (kind & _SPACE != 0) & (plain >= 0) & (kind[plain] & _STOP != 0)
        line = kind & _LINE != 0
        if line.any():
            ended |= line & (before(line) > before(kind & _SPACE == 0))
        passed = np.cumsum(ended)[start]
        new_text = np.diff(text_of, prepend=-1) != 0
        s_at_word = np.flatnonzero(new_text | (np.diff(passed, prepend=-1) != 0))
        rows = text_of[new_text]
        sl = np.diff(np.r_[s_at_word, len(start)]).astype(float)
        w_at = np.flatnonzero(new_text)  # first word of each text
        s_at = np.searchsorted(s_at_word, w_at)  # first sentence of each text
        n, m = np.diff(np.r_[w_at, len(start)]), np.diff(np.r_[s_at, len(sl)])
        doc = np.repeat(np.arange(len(n)), n)
        u, first, word = np.unique(h, return_index=True, return_inverse=True)
        facts = self._facts(u, lambda i: codes[start[first[i]] : start[first[i]] + size[first[i]]].tobytes().decode("utf-32-le", "surrogatepass"))
        length, syl, rare, sort = facts[word].T
        sort = sort.astype(np.int64)
        # marks are counted in the texts as they are
        raw = _kinds()[1][_codes("".join(texts))]
        sizes = np.array([len(t) for t in texts])
        k = len(_MARKS) + 3
        marks = np.bincount(np.repeat(np.arange(len(texts)), sizes) * k + raw, minlength=len(texts) * k).reshape(-1, k)[rows, 1:]
        per_word = lambda x: np.add.reduceat(x.astype(float), w_at) / n
        per_sent = lambda x: np.add.reduceat(x.astype(float), s_at) / m
        spread = lambda f, x: np.sqrt(np.maximum(f(x * x) - f(x) ** 2, 0))
        sr = np.add.reduceat(rare, s_at_word) / sl
        # sorted within each text: one key of text and value
        ro = np.sort(doc * 64.0 + rare) - np.repeat(np.arange(len(n)), n) * 64.0
        so = sl[np.lexsort((sl, np.repeat(np.arange(len(m)), m)))]
        # share of different words in windows of 100, so that length has no part in it; a short last window has none unless it is the only one
        pos = np.arange(len(word)) - w_at[doc]
        new_window = pos % 100 == 0
        window = np.cumsum(new_window) - 1
        inside = np.bincount(window)
        different = np.bincount(_runs(window << 32 | word)[0] >> 32, minlength=len(inside))
        w_doc = doc[new_window]
        full = (inside >= 50) | (pos[new_window] == 0)
        ttr = np.bincount(w_doc[full], weights=(different / inside)[full], minlength=len(n)) / np.bincount(w_doc[full], minlength=len(n))
        pairs, times = _runs(doc << 32 | word)
        once = np.bincount((pairs >> 32)[times == 1], minlength=len(n))
        has = [per_word(sort >> b & 1) for b in range(6)]
        commas, semis, exclaims, brackets, hyphens, digits, upper = marks.T
        chars = sizes[rows]
        log_sl, mean_len = np.log(n / m), per_word(length)
        out[rows] = np.stack([
            mean_len, spread(per_word, length), per_word(length >= 7), per_word(length >= 10), per_word(syl), per_word(syl >= 3), log_sl, np.log1p(spread(per_sent, sl)), np.log(so[s_at + m // 4]), np.log(so[s_at + 3 * m // 4]), np.log(so[s_at + m - 1]), per_sent(sl <= 8),
            per_word(rare), ro[w_at + 3 * n // 4], ro[w_at + 19 * n // 20], per_word(rare > 14), spread(per_sent, sr), ttr, once / n, has[0], has[1], commas / m, (commas + has[1] * n) / m, semis / m, has[5],
            has[2], has[3] + exclaims / m, digits / chars, brackets / m, upper / chars, hyphens / n, log_sl * mean_len, has[4],
        ], axis=1)
        return out


_SETS = [frozenset(x) for x in (CONNECTIVES, SUBORDINATORS, PRONOUNS, EXCLAIMS)]


def _blank(t: str | None) -> bool:
    return t is None or not t.strip()


def text_features(docs: DataFrame, keep: list[str], text_col: str, table: tuple[np.ndarray, np.ndarray], model: OrdinalModel | None = None) -> DataFrame:
    """``keep`` columns and f (array of double) for every row, or with a ``model``
    level_no and score; null for null and blank texts. A task has one reader."""
    shared = docs.sparkSession.sparkContext.broadcast((table, model))
    src = docs.select(*keep, text_col)
    made = T.StructType.fromDDL("f array<double>" if model is None else "level_no int, score double").fields
    names = [*keep, *[f.name for f in made]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, model = shared.value
        reader = Reader(table)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            at = [i for i, t in enumerate(texts) if not _blank(t)]
            x = reader.features([texts[i] for i in at])
            back = np.full(len(texts), -1)
            back[at] = np.arange(len(at))
            index = pa.array(np.where(back < 0, 0, back), mask=back < 0)
            if model is None:
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
                cols = [values.take(index)]
            else:
                cols = [pa.array(model.predict(x).astype(np.int32)).take(index), pa.array(model.score(x)).take(index)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *cols], names=names)

    return src.mapInArrow(run, T.StructType([*src.schema.fields[: len(keep)], *made]))


class OrdinalModel:
    """Cumulative logits: P(level <= k) = sigmoid(threshold_k - w.x)."""

    def __init__(self, mean, scale, w, cuts, levels):
        self.mean, self.scale, self.w, self.cuts, self.levels = mean, scale, w, cuts, levels

    @classmethod
    def fit(cls, x: np.ndarray, level: np.ndarray, penalty: float = PENALTY, rounds: int = 400) -> OrdinalModel:
        levels = np.unique(level)
        mean, scale = x.mean(0), x.std(0)
        scale[scale < 1e-9] = 1.0
        z = (x - mean) / scale
        n, d, k = len(z), z.shape[1], len(levels)
        y = np.searchsorted(levels, level)
        if k < 2:
            return cls(mean, scale, np.zeros(d), np.zeros(0), levels)
        share = np.clip(np.cumsum(np.bincount(y, minlength=k))[:-1] / n, 1e-3, 1 - 1e-3)
        # unknowns: weights, the first threshold, and the logs of the gaps between thresholds
        first = np.log(share / (1 - share))
        t = np.r_[np.zeros(d), first[0], np.log(np.maximum(np.diff(first), 0.05))]

        def loss(t):
            w, cuts = t[:d], np.cumsum(np.r_[t[d], np.exp(t[d + 1 :])])
            s = z @ w
            hi = np.where(y < k - 1, np.r_[cuts, 0][y] - s, 40.0)
            lo = np.where(y > 0, np.r_[0, cuts][y] - s, -40.0)
            a, b = 1 / (1 + np.exp(-np.clip(hi, -40, 40))), 1 / (1 + np.exp(-np.clip(lo, -40, 40)))
            p = np.maximum(a - b, 1e-12)
            da, db = a * (1 - a) / p, b * (1 - b) / p
            da[y == k - 1] = 0
            db[y == 0] = 0
            gs = (da - db) / n
            gw = z.T @ gs + 2 * penalty * w
            gc = np.zeros(k - 1)
            np.add.at(gc, np.minimum(y, k - 2), -da / n)
            np.add.at(gc, np.maximum(y - 1, 0), db / n)
            tail = np.cumsum(gc[::-1])[::-1]
            return -np.log(p).mean() + penalty * w @ w, np.r_[gw, tail[0], tail[1:] * np.exp(t[d + 1 :])]

        t = _lbfgs(loss, t, rounds)
        return cls(mean, scale, t[:d], np.cumsum(np.r_[t[d], np.exp(t[d + 1 :])]), levels)

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The level of greatest probability."""
        s = self.score(x)[:, None]
        upper = 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - s, -40, 40)))
        p = np.diff(np.c_[np.zeros(len(s)), upper, np.ones(len(s))], axis=1)
        return self.levels[p.argmax(1)]


def _lbfgs(f, x: np.ndarray, rounds: int, memory: int = 12) -> np.ndarray:
    fx, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y in reversed(past):
            a = s @ q / (y @ s)
            alphas.append(a)
            q -= a * y
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(alphas)):
            q += s * (a - y @ q / (y @ s))
        step, slope = 1.0 if past else min(1.0, 1 / (np.abs(g).sum() + 1e-12)), -(g @ q)
        if slope > 0:
            q, slope, past = g.copy(), -(g @ g), []
        for _ in range(40):
            new, gn = f(x - step * q)
            if new <= fx + 1e-4 * step * slope:
                break
            step /= 2
        else:
            return x
        s, y = -step * q, gn - g
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y)]
        if abs(fx - new) < 1e-10 * max(1.0, abs(fx)):
            return x - step * q
        x, fx, g = x - step * q, new, gn
    return x


def fit_levels(docs: DataFrame, graded: DataFrame, text_col: str, table: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id") -> OrdinalModel | None:
    """Fit to the texts of ``graded`` (doc_id, level_no); None if none has words."""
    pick = graded.where("level_no is not null").orderBy(F.xxhash64(id_col), id_col).limit(MAX_GRADED).select(id_col, "level_no")
    # at most MAX_GRADED rows
    texts = docs.select(id_col, text_col).join(F.broadcast(pick), id_col)
    rows = text_features(texts, [id_col, "level_no"], text_col, table).where("f is not null").orderBy(id_col, "level_no", "f").toPandas()
    if rows.empty:
        return None
    return OrdinalModel.fit(np.stack(rows["f"].to_numpy()).astype(float), rows["level_no"].to_numpy())


def read_levels(docs: DataFrame, graded: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns (doc_id among them) and level_no (int), score (double) of
    every document; both null for null and blank texts, and for all if nothing is
    graded. Very long texts are read whole. Repeated rows get the same level; a
    graded id that occurs in several rows counts as often. Empty tables give none.
    """
    table = count_words(docs, text_col)
    model = fit_levels(docs, graded, text_col, table)
    if model is None:
        return docs.select(*keep, F.lit(None).cast("int").alias("level_no"), F.lit(None).cast("double").alias("score"))
    return text_features(docs, keep, text_col, table, model)

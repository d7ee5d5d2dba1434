"""Mapping of free-entered values to a canonical list (problem 5).

Every entry of the reference list is known by aliases: its spellings and
notations. Each alias is filed under all strings that come from it by up to
``max_edits`` deletions (symmetric deletes); a key is looked up under its own
deletes, so that every alias within that edit distance shares a string with it.
The candidates are ranked by weighted Damerau-Levenshtein distance, then by how
often the entry is written in the data, then by entry id.

A value is looked up as a whole. If that fails, its words, numbers and signs are
looked up from the left, the longest run first: each must be an alias or a word
that says nothing (a filler, by the same lookup). Aliases that are found must
agree, or together be an entry that is written as a list of others ('+3/+5').
Anything else is a miss (entry 0). So every value goes through the dictionary.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import combinations, product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

#: A dictionary of at most so many alias deletes is broadcast; a larger one is joined by shuffle.
BROADCAST_KEYS = 500_000
#: Words under this length are compared exactly: one edit in a symbol or number makes another one.
FUZZY_FROM = 5

#: Longest run of words, numbers and signs that is looked up together.
LONGEST_RUN = 4

# Words that say nothing about the state.
STATE_FILLERS = "sb antimony stibium antimon all as formal formally probably presumably likely oxid oxidation state states number assigned reported centre centres center centers site sites in of is with from bvs valence".split()
# Words that say nothing about which halide it is.
HALIDE_FILLERS = "two three four bridging terminal bound coordinated free apical axial equatorial anion anions ion ions atom atoms ligand ligands salt salts counter mu mu2 mu3 mu4 μ μ2 μ3 μ4".split()
# What stands between the states of a list.
JOINERS = ["/", ",", "&", "and", "und"]
# Number words, Roman numerals and the valence adjectives.
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five"]
ROMAN = ["", "i", "ii", "iii", "iv", "v"]
VALENT = [["zerovalent", "zero-valent"], ["monovalent"], ["divalent"], ["trivalent", "tervalent"], ["tetravalent", "quadrivalent"], ["pentavalent", "quinquevalent"]]
ELEMENT = ["antimony", "stibium", "antimon"]
# Stems of the halogens, English and German, by element symbol.
HALOGENS = {"F": ["fluor"], "Cl": ["chlor"], "Br": ["brom"], "I": ["iod", "jod"], "At": ["astat"]}
SUFFIXES = ["ide", "ides", "ido", "o", "ine", "id", "idion", "in"]
# Names close to a halide that are none.
NOT_HALIDES = ["chlorite", "chlorate", "bromite", "bromate", "iodite", "iodate", "oxide", "azide", "imide", "amide", "iodoform", "chloroform", "bromoform"]
#: Arsenic, not the word "as": bound to its state.
_ARSENIC = re.compile(r"\s*As\s*(?:\(|\d|[IV]+\b(?! ))")


def deletes(s: str, k: int) -> set[str]:
    """``s`` and all that is left of it after up to ``k`` deletions."""
    out = {s}
    for n in range(1, min(k, len(s)) + 1):
        out |= {"".join(c for i, c in enumerate(s) if i not in drop) for drop in map(set, combinations(range(len(s)), n))}
    return out


def weighted_distance(a: str, b: str, limit: float = 9.0) -> float:
    """Damerau-Levenshtein with 0.8 for a transposition, 0.9 for a doubled or
    missing double letter, 1 for any other insertion or deletion, 1.1 for a substitution."""
    if a == b:
        return 0.0
    prev2: list[float] = []
    prev = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        cur = [float(i)]
        for j, y in enumerate(b, 1):
            drop = prev[j] + (0.9 if i > 1 and a[i - 2] == x else 1.0)
            add = cur[j - 1] + (0.9 if j > 1 and b[j - 2] == y else 1.0)
            best = min(drop, add, prev[j - 1] + (0.0 if x == y else 1.1))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, prev2[j - 2] + 0.8)
            cur.append(best)
        if min(cur) > limit:
            return limit + 1
        prev2, prev = prev, cur
    return prev[-1]


def plain(s: str) -> str:
    """Compatibility form in lower case, one kind of minus and of mu, single blanks, no outer stops."""
    s = unicodedata.normalize("NFKC", s).lower()
    s = re.sub("[‐‑‒–—−]", "-", s).replace("µ", "μ")
    return re.sub(r"\s+", " ", s).strip(" .;,")


_TOKEN = re.compile(r"[^\W\d_]+|\d+|[+\-/,&]")


def state_aliases(entry: str, full_name: str | None) -> list[str]:
    """Aliases of an oxidation state entry such as '+3'; of a list of states, what names
    it as a whole. An entry that is no state has its own spellings only."""
    out = [entry, *([full_name] if full_name else [])]
    if "/" in entry:
        return [*out, "mixed valence", "mixed-valence", "mixed valent", "mixed-valent"]
    if not re.fullmatch(r"[+-]?\d", entry) or abs(int(entry)) >= len(ROMAN):
        return out
    n = int(entry)
    k, sign = abs(n), "-" if n < 0 else "+"
    for x in {str(k), ROMAN[k]} - {""}:
        out += [sign + x, x + sign] + ([x] if n >= 0 else [])
    if n > 0:
        # as one token after the element's symbol, and with i read as l or 1
        out += ["sb" + ROMAN[k]]
        out += ["".join(x) for x in product(*[("i", "l", "1") if c == "i" else (c,) for c in ROMAN[k]])] if k > 1 else []
    if n >= 0:
        out += [NUMBER_WORDS[k], *VALENT[k], *[w + e for w in VALENT[k] for e in ELEMENT]]
    if n == 0:
        out += ["elemental", "metallic", "metal", *["elemental" + e for e in ELEMENT]]
    if n < 0:
        out += ["stibide"]
    return out


def halide_aliases(entry: str, full_name: str | None) -> list[str]:
    """Aliases of a halide entry such as 'Cl' or 'I3'; an entry that is none has its own spellings only."""
    out = [entry, entry.replace("l", "1"), *([full_name] if full_name else [])]
    m = re.fullmatch(r"([A-Z][a-z]?)(\d*)", entry)
    for stem in HALOGENS.get(m[1], []) if m else []:
        out += [("tri" if m[2] == "3" else "") + stem + x for x in SUFFIXES]
    return out


@dataclass(frozen=True)
class Lexicon:
    """How the values of one vocabulary are written."""

    aliases: Callable[[str, str | None], list[str]] = lambda entry, full: [x for x in (entry, full) if x]
    fillers: list[str] = field(default_factory=list)
    nothing: list[str] = field(default_factory=list)
    ignored: str = ""
    foreign: re.Pattern | None = None

    def tokens(self, value: str) -> list[str]:
        """Words, numbers and signs of a value; none if it speaks of something else."""
        if self.foreign and self.foreign.match(unicodedata.normalize("NFKC", value)):
            return []
        return [t for t in _TOKEN.findall(plain(value)) if t not in self.ignored]

    def keys_of_entry(self, entry: str, full_name: str | None) -> list[str]:
        return sorted({k for a in self.aliases(entry, full_name) if (k := "".join(self.tokens(a)))})

    def runs(self, value: str) -> list[str]:
        """Every key that read() may look up."""
        t = self.tokens(value)
        return sorted({"".join(t)} | {"".join(t[i : i + n]) for i in range(len(t)) for n in range(1, LONGEST_RUN + 1) if i + n <= len(t)} - {""})

    def read(self, value: str, find: Callable[[str], tuple[int, float]]) -> tuple[list[int], float]:
        """(entries that the value names, sum of the distances); none for a miss."""
        t = self.tokens(value)
        if not t:
            return [], -1.0
        entry, far = find("".join(t))
        if entry:
            return [entry], far
        says_nothing = _fillers(tuple(self.fillers))
        i, got, total = 0, set(), 0.0
        while i < len(t):
            for n in range(min(LONGEST_RUN, len(t) - i), 0, -1):
                key = "".join(t[i : i + n])
                if key in JOINERS or says_nothing.find(key)[1] == 0:
                    break
                entry, far = find(key) if n == 1 or not key.isalpha() else _exact(find, key)
                if entry:
                    got.add(entry)
                    total += far
                    break
                if n == 1 and says_nothing.find(key)[0]:
                    break
            else:
                return [], -1.0
            i += n
        return sorted(got), total if got else -1.0


def _exact(find: Callable[[str], tuple[int, float]], key: str) -> tuple[int, float]:
    entry, far = find(key)
    return (entry, far) if far == 0 else (0, -1.0)


LEXICONS: dict[str, Lexicon] = {
    "oxidation_state": Lexicon(state_aliases, STATE_FILLERS, [], "", _ARSENIC),
    "halide": Lexicon(halide_aliases, HALIDE_FILLERS, NOT_HALIDES, "-"),
}
PLAIN = Lexicon()


class Dictionary:
    """Symmetric-delete index of keys; ``nothing`` are keys near others that name none."""

    def __init__(self, aliases: Iterable[tuple[str, int]], weight: dict[int, int], nothing: Iterable[str] = (), max_edits: int = 1):
        self.exact: dict[str, set[int]] = defaultdict(set)
        self.index: dict[str, set[str]] = defaultdict(set)
        self.weight, self.nothing, self.max_edits, self.longest = weight, frozenset(nothing), max_edits, 0
        for a, e in aliases:
            self.exact[a].add(e)
            self.longest = max(self.longest, len(a))
            if _fuzzy(a, FUZZY_FROM):
                for x in deletes(a, max_edits):
                    self.index[x].add(a)
        self.memo: dict[str, tuple[int, float]] = {}

    def find(self, key: str) -> tuple[int, float]:
        """(entry id, distance); (0, -1) for a miss."""
        if key not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[key] = self._find(key)
        return self.memo[key]

    def _find(self, key: str) -> tuple[int, float]:
        if key in self.nothing:
            return 0, -1.0
        if key in self.exact:
            return min(self.exact[key], key=lambda e: (-self.weight.get(e, 0), e)), 0.0
        # a key longer than any alias within the distance has no candidate
        if not _fuzzy(key, FUZZY_FROM - 1) or len(key) > self.longest + self.max_edits:
            return 0, -1.0
        near = {a for x in deletes(key, self.max_edits) for a in self.index.get(x, ())}
        ranked = sorted((d, -self.weight.get(e, 0), e) for a in near if (d := weighted_distance(key, a)) <= 1.1 * self.max_edits for e in self.exact[a])
        return (ranked[0][2], ranked[0][0]) if ranked else (0, -1.0)


def _fuzzy(key: str, least: int) -> bool:
    return len(key) >= least and key.isalpha()


@cache
def _fillers(words: tuple[str, ...]) -> Dictionary:
    return Dictionary([(w, 1) for w in words], {})


def _parts(entry: str) -> str:
    """An entry as the sorted list of what it is made of."""
    return "/".join(sorted(x.strip() for x in entry.split("/")))


def map_values(values: DataFrame, reference: DataFrame, max_edits: int = 1) -> DataFrame:
    """Map ``values`` (row_id, field_name, pos, vocab, value) to ``reference``
    (entry_id, vocab, entry, full_name): adds entry_id (0: fits none) and distance
    (weighted edits; -1 for a miss).

    Null and blank values are dropped. A vocabulary without entries gives misses;
    one without lexicon is compared by its entries and full names alone; an entry
    that its lexicon can't read keeps its own spellings. Of entries equally near,
    the one written more often in the data is taken, then the smaller id. Values of
    any length are taken whole. Repeated rows stay.
    """
    values = values.where(F.length(F.regexp_replace("value", r"[\s ]+", "")) > 0)
    reference = reference.where("entry is not null and entry_id is not null").select("entry_id", "vocab", "entry", "full_name")
    # how often each entry is written exactly: at most one row an entry
    uses = values.join(reference.select("vocab", F.col("entry").alias("value"), "entry_id"), ["vocab", "value"]).groupBy("entry_id").count()
    size = reference.agg(F.count(F.lit(1)), F.sum(F.length("entry") + F.length(F.coalesce("full_name", F.lit(""))) + 40)).first()
    if (size[1] or 0) > BROADCAST_KEYS:
        return _map_by_join(values, reference, uses, max_edits)
    weight = {r["entry_id"]: r["count"] for r in uses.collect()}
    rows = [tuple(r) for r in reference.orderBy("entry_id").collect()]
    shared = values.sparkSession.sparkContext.broadcast((rows, weight))

    @F.pandas_udf("struct<entry_id:long,distance:double>")
    def look_up(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        books = make_books(*shared.value, max_edits)
        memo: dict[tuple[str, str], tuple[int, float]] = {}
        for vocab, value in batches:
            out = []
            for key in zip(vocab, value):
                if key not in memo:
                    if len(memo) > 200_000:
                        memo.clear()
                    memo[key] = find_value(books, *key)
                out.append(memo[key])
            yield pd.DataFrame(out, columns=["entry_id", "distance"])

    return values.withColumn("m", look_up("vocab", "value")).select(*values.columns, "m.entry_id", "m.distance")


def make_books(rows: list[tuple], weight: dict[int, int], max_edits: int = 1) -> dict[str, tuple[Lexicon, Dictionary, dict[str, int], dict[int, str]]]:
    """Of each vocabulary: lexicon, dictionary, entries by their parts, parts by entry."""
    by_vocab: dict[str, list[tuple]] = defaultdict(list)
    for r in rows:
        by_vocab[r[1]].append(r)
    out = {}
    for vocab, entries in by_vocab.items():
        lex = LEXICONS.get(vocab, PLAIN)
        book = Dictionary([(k, e) for e, _, name, full in entries for k in lex.keys_of_entry(name, full)], weight, lex.nothing, max_edits)
        out[vocab] = (lex, book, {_parts(name): e for e, _, name, _ in reversed(entries)}, {e: _parts(name) for e, _, name, _ in entries})
    return out


def find_value(books: dict, vocab: str, value: str) -> tuple[int, float]:
    """(entry id, distance) of a value; (0, -1) for a miss."""
    if vocab not in books:
        return 0, -1.0
    lex, book, by_parts, parts = books[vocab]
    got, far = lex.read(value, book.find)
    if len(got) == 1:
        return got[0], far
    both = by_parts.get("/".join(sorted({x for e in got for x in parts[e].split("/")}))) if got else None
    return (both, far) if both else (0, -1.0)


def _map_by_join(values: DataFrame, reference: DataFrame, uses: DataFrame, max_edits: int) -> DataFrame:
    """The same for a reference list that is too large to broadcast. The keys of the
    distinct values and the aliases meet at their deletes in a shuffle join; what
    each key leads to goes back to its value, which is then read as before, and an
    entry made of several is looked up by its parts in a last join."""

    @F.pandas_udf("array<struct<alias:string,d:string>>")
    def alias_deletes(vocab: pd.Series, entry: pd.Series, full: pd.Series) -> pd.Series:
        out = []
        for v, e, f in zip(vocab, entry, full):
            out.append([{"alias": a, "d": d} for a in LEXICONS.get(v, PLAIN).keys_of_entry(e, f) for d in (deletes(a, max_edits) if _fuzzy(a, FUZZY_FROM) else {a})])
        return pd.Series(out, dtype=object)

    @F.pandas_udf("array<string>")
    def runs(vocab: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([LEXICONS.get(v, PLAIN).runs(x) for v, x in zip(vocab, value)], dtype=object)

    @F.pandas_udf("array<string>")
    def key_deletes(vocab: pd.Series, key: pd.Series, longest: pd.Series) -> pd.Series:
        out = []
        for v, k, n in zip(vocab, key, longest):
            near = _fuzzy(k, FUZZY_FROM - 1) and len(k) <= n + max_edits
            out.append([] if k in LEXICONS.get(v, PLAIN).nothing else sorted(deletes(k, max_edits)) if near else [k])
        return pd.Series(out, dtype=object)

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([weighted_distance(x, y) for x, y in zip(a, b)])

    @F.pandas_udf("struct<entry_id:long,distance:double,parts:string>")
    def read(vocab: pd.Series, value: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for v, x, rows in zip(vocab, value, found):
            table = {r["key"]: r for r in (rows if rows is not None else [])}
            names = {r["entry_id"]: r["entry"] for r in table.values()}
            got, far = LEXICONS.get(v, PLAIN).read(x, lambda k, t=table: (t[k]["entry_id"], t[k]["distance"]) if k in t else (0, -1.0))
            both = "/".join(sorted({p for e in got for p in _parts(names[e]).split("/")})) if len(got) > 1 else None
            out.append((got[0] if len(got) == 1 else 0, far if got else -1.0, both))
        return pd.DataFrame(out, columns=["entry_id", "distance", "parts"])

    @F.pandas_udf("string")
    def parts_of(entry: pd.Series) -> pd.Series:
        return entry.map(_parts)

    distinct = values.select("vocab", "value").distinct()
    keyed = settle(distinct.withColumn("key", F.explode(runs("vocab", "value"))), "runs")
    right = reference.withColumn("x", F.explode(alias_deletes("vocab", "entry", "full_name"))).select("vocab", "entry_id", "entry", "x.alias", "x.d")
    longest = right.agg(F.coalesce(F.max(F.length("alias")), F.lit(0)).alias("longest"))
    keys = keyed.select("vocab", "key").distinct().join(F.broadcast(longest))  # one row
    left = keys.withColumn("d", F.explode(key_deletes("vocab", "key", "longest"))).select("vocab", "key", "d")
    pairs = left.join(right, ["vocab", "d"]).select("vocab", "key", "alias", "entry_id", "entry").distinct()
    # as in the dictionary: an alias that may not be misspelt, or a key too short for it, must be the key itself
    pairs = pairs.withColumn("distance", distance("key", "alias")).where(F.col("distance") <= 1.1 * max_edits)
    pairs = pairs.join(uses, "entry_id", "left")
    best = pairs.groupBy("vocab", "key").agg(F.min(F.struct("distance", (-F.coalesce("count", F.lit(0))).alias("w"), "entry_id", "entry")).alias("b"))
    met = keyed.join(best, ["vocab", "key"]).groupBy("vocab", "value").agg(F.collect_list(F.struct("key", "b.entry_id", "b.entry", "b.distance")).alias("found"))
    done = distinct.join(met, ["vocab", "value"], "left").withColumn("m", read("vocab", "value", "found")).select("vocab", "value", "m.*")
    lists = reference.select("vocab", parts_of("entry").alias("parts"), F.col("entry_id").alias("list_id")).groupBy("vocab", "parts").agg(F.min("list_id").alias("list_id"))
    done = done.join(lists, ["vocab", "parts"], "left")
    many = F.col("parts").isNotNull()
    done = done.select("vocab", "value", F.when(many, F.coalesce("list_id", F.lit(0))).otherwise(F.col("entry_id")).alias("entry_id"), F.when(many & F.col("list_id").isNull(), -1.0).otherwise(F.col("distance")).alias("distance"))
    out = values.join(done.hint("merge"), ["vocab", "value"], "left")
    return out.select(*values.columns, F.coalesce("entry_id", F.lit(0)).cast("long").alias("entry_id"), F.coalesce("distance", F.lit(-1.0)).alias("distance"))

"""Splitting of fields that pack several values (problem 2).

A parsing expression grammar with ordered alternatives and backtracking reads
each field::

    field     <- item (separator item)* end
    item      <- blank* (quoted / bare) blank*
    quoted    <- open (escaped / !close any)* close &(blank* (separator / end))
    bare      <- (bracketed / !separator any)*
    bracketed <- '(' nested ')' / '[' nested ']' / '{' nested '}'

A quote without a valid close, or a bracket without its partner, makes its
alternative fail; the parser backtracks and reads the mark as an ordinary
character, with an error flag. What separates depends on the kind of field, see
``Field``, which remembers what each rule gave where, as a packrat parser does.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quote marks with their closing partners, and bracket pairs.
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "‘": "’", "«": "»"}
BRACKETS = {"(": ")", "[": "]", "{": "}"}

_LABEL_SEP = re.compile(r"[;|/,&\t\n\r\v\f\x85  、；，／｜]+|[  ]+and[  ]+")
#: A run in which commas may stand between the locants of a chemical name, as in 2,2'-bipyridine, one locant, and what follows the last.
_LOCANT_RUN, _LOCANT = re.compile(r"[\dN'′,]+"), re.compile(r"(?:\d+|N)['′]*")
_LOCANT_END = re.compile(r"-[a-zα-ω(\[]{3}")
_ENTRY_SEP = re.compile(r"[;|/,&\t\n\r\v\f\x85  ；，／｜]")
_ENTRY_RUN = re.compile(r"[\s;|/,&\t\n\r\v\f\x85  ；，／｜]*")
_ENTRY_START = re.compile(r"""[\s;|/,&]*["'“„‘«]?\s*[^\W\d_][\w*'′+\-]{0,23}\s*[=:]\s*\S""")
_BLANKS = re.compile(r"\s*")
_SPECIAL = re.compile("[" + re.escape("".join([*QUOTES, *BRACKETS])) + ";|/,&\\s、；，／｜]")


class Field:
    """One field's text and what its parse has found out so far: partners of brackets,
    closes of quotes, ends of runs of separators. Each is worked out once for the
    whole text, when it is first asked for, so a parse is linear in the text."""

    def __init__(self, text: str, kind: str):
        self.s = text
        self.separator = {"label": self._label, "entry": self._entry}[kind]
        self._partners: dict[int, int] | None = None
        self._closes: dict[tuple[str, bool], list[int]] = {}
        self._locants: set[int] | None = None
        self._run = (0, 0, 0)

    def _label(self, i: int) -> int:
        """Length of the separator of a list of labels at ``i``; 0 if there is none.
        A comma between locants of a chemical name separates nothing."""
        m = _LABEL_SEP.match(self.s, i)
        if not m or self.s[i] == "," and i in self.locant_commas():
            return 0
        return m.end() - i

    def _entry(self, i: int) -> int:
        """Length of the separator of a list of "symbol sign definition" entries.
        A mark separates only if an entry, another mark or the end follows it, so
        that commas and semicolons within a definition stay in it."""
        if not _ENTRY_SEP.match(self.s, i):
            return 0
        begin, end, ok = self._run
        if not begin <= i < end:  # all marks of a run end with it
            end = _ENTRY_RUN.match(self.s, i).end()
            ok = end == len(self.s) or bool(_ENTRY_START.match(self.s, end))
            self._run = (i, end, ok)
        return end - i if ok else 0

    def locant_commas(self) -> set[int]:
        if self._locants is None:
            out: set[int] = set()
            for run in _LOCANT_RUN.finditer(self.s):
                if "," not in run[0] or not _LOCANT_END.match(self.s, run.end()):
                    continue
                at = run.end()
                for part in reversed(run[0].split(",")):
                    comma = at - len(part) - 1
                    if comma < run.start() or not _LOCANT.fullmatch(part):
                        break
                    if comma > 0 and (self.s[comma - 1].isdigit() or self.s[comma - 1] in "N'′"):
                        out.add(comma)
                    at = comma
            self._locants = out
        return self._locants

    def bracketed(self, i: int) -> int:
        """End of the balanced bracket that opens at ``i``; -1 if it has no partner. From the
        right, each bracket steps over those inside it, which are known by then."""
        if self._partners is None:
            marks = [j for j, c in enumerate(self.s) if c in BRACKETS or c in _CLOSING]
            place = {j: k for k, j in enumerate(marks)}
            self._partners = {}
            for k in range(len(marks) - 1, -1, -1):
                c = self.s[marks[k]]
                if c not in BRACKETS:
                    continue
                n, found = k + 1, -1
                while n < len(marks):
                    j = marks[n]
                    if self.s[j] in BRACKETS:
                        if (e := self._partners[j]) < 0:
                            break
                        n = place[e - 1] + 1
                    elif self.s[j] == BRACKETS[c]:
                        found = j + 1
                        break
                    else:
                        n += 1
                self._partners[marks[k]] = found
        return self._partners[i]

    def _ends(self, j: int) -> bool:
        """Whether a separator or the end follows ``j``, blanks aside."""
        k = _BLANKS.match(self.s, j).end()
        return k == len(self.s) or any(self.separator(x) for x in range(j, k + 1))

    def close_of(self, j: int, mark: str, doubling: bool) -> int:
        """The first ``mark`` from ``j`` on that may close a quote; -1 if there is none.
        With ``doubling``, two marks in a row are one that closes nothing."""
        table = self._closes.get((mark, doubling))
        if table is None:
            s = self.s
            table = [-1] * (len(s) + 2)
            for i in range(len(s) - 1, -1, -1):
                if s[i] != mark:
                    table[i] = table[i + 1]
                elif doubling and s.startswith(mark, i + 1):
                    table[i] = table[i + 2]
                else:
                    table[i] = i if self._ends(i + 1) else table[i + 1]
            self._closes[mark, doubling] = table
        return table[j]

    def quoted(self, i: int) -> tuple[str, int] | None:
        """Ordered alternatives: doubled marks read as one; else every mark may close."""
        close = QUOTES[self.s[i]]
        for doubling in ((True, False) if close == self.s[i] else (False,)):
            j = self.close_of(i + 1, close, doubling)
            if j >= 0:
                inner = self.s[i + 1 : j]
                return (inner.replace(close * 2, close) if doubling else inner), j + 1
        return None

    def bare(self, i: int) -> tuple[str, int, str | None]:
        s, j, flag, balanced = self.s, i, None, True
        while j < len(s):
            m = _SPECIAL.search(s, j)
            if not m:
                j = len(s)
                break
            j = m.start()
            if s[j] in BRACKETS and balanced:
                k = self.bracketed(j)
                if k > 0:
                    j = k
                    continue
                flag, balanced = "unbalanced_bracket", False
            elif self.separator(j):
                break
            j += 1
        return s[i:j], j, flag


_CLOSING = frozenset(BRACKETS.values())


def parse_packed(s: str, kind: str) -> list[tuple[str, str | None]]:
    """(value, error flag) of every value of one field of a ``kind`` ('label' or
    'entry'), blank pieces dropped."""
    f = Field(s, kind)
    out: list[tuple[str, str | None]] = []
    i = 0
    while i < len(s):
        i = _BLANKS.match(s, i).end() if not f.separator(i) else i
        if i < len(s) and (n := f.separator(i)):
            i += n
            continue
        if i >= len(s):
            break
        flag = None
        if s[i] in QUOTES:
            if (q := f.quoted(i)) is not None:
                value, i = q
                if value.strip():
                    out.append((value.strip(), None))
                i = _BLANKS.match(s, i).end() if i < len(s) and not f.separator(i) else i
                continue
            flag = "malformed_quote"
        value, j, bad = f.bare(i)
        i = max(j, i + 1)
        if value.strip():
            out.append((value.strip(), flag or bad))
    return out


def split_column(col: Column, kind: str) -> Column:
    """array<struct<value,flag>> of a packed column; ``kind`` is 'label' or 'entry'."""
    @F.pandas_udf("array<struct<value:string,flag:string>>")
    def parse(texts: pd.Series) -> pd.Series:
        memo: dict[str, list[dict]] = {}
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            if t not in memo:
                memo[t] = [{"value": v, "flag": f} for v, f in parse_packed(t, kind)]
            out.append(memo[t])
        return pd.Series(out, dtype=object)

    return parse(col)


def unpack(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """One row for each value of the packed ``fields`` ({column: 'label' | 'entry'}).

    Output: ``id_col``, field_name, pos (int, from 1), packed_value, n_values
    (values of that field and row), flag (null, 'malformed_quote' or
    'unbalanced_bracket').

    Null, empty, blank fields and fields of separators only give no rows.
    Repeated rows of the input are split each on its own; order of rows, ties
    and further columns of the input have no influence. An empty table gives an
    empty result. Length is unlimited: the work is linear in it.
    """
    parts = None
    for name, kind in fields.items():
        one = df.select(F.col(id_col).alias("__id"), F.col(name).alias("__v")).where(F.length(F.trim("__v")) > 0)
        one = one.select("__id", F.lit(name).alias("field_name"), split_column(F.col("__v"), kind).alias("__p"))
        parts = one if parts is None else parts.unionByName(one)
    out = parts.select(
        F.col("__id").alias(id_col),
        "field_name",
        F.size("__p").alias("n_values"),
        F.posexplode("__p").alias("__i", "__s"),
    )
    return out.select(
        id_col,
        "field_name",
        (F.col("__i") + 1).cast("int").alias("pos"),
        F.col("__s.value").alias("packed_value"),
        "n_values",
        F.col("__s.flag").alias("flag"),
    )

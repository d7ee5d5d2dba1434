"""Visually identical text with different characters (problem 6).

Arrow text is copied to one numpy array of code points for a whole batch. A
lookup table gives every code point the number of code points it becomes (0: it
is dropped) and where they stand in a pool; a gather with running offsets
expands them all at once. Marks are then sorted and composed pairwise over the
whole array, until no pair composes. No string function is called for a row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like a Latin letter, with that letter.
LOOKALIKES = {
    "АВЕЅІЈКМНОРСТХУԌԚԜҮӀ": "ABESIJKMHOPCTXYGQWYI",
    "аеіјорсухѕһԁԛԝӏүᴄ": "aeijopcyxshdqwlyc",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ": "ABEZHIKMNOPTYXCJ",
    "οϲϳ": "ocj",
    "ՕՏԼ": "OSL",
    "օսհոց": "ouhng",
    "ıɑɡ": "iag",
}
# Characters that look like an ASCII mark or the middle dot, with that mark.
MARKS = {
    "‐‑‒–—―−﹘﹣": "-",
    "‧∙•⋅・･": "·",
    "ʹʼ‘’‛＇": "'",
    "“”‟〃": '"',
    "∕⁄": "/",
    "∶": ":",
    "∣ǀ": "|",
    "˗": "-",
    "∗": "*",
    "∼": "~",
}
# Invisible additions (zero widths, joiners, direction marks, soft hyphen, fillers), as code point ranges.
INVISIBLE = [(0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xE0000, 0xE007F), (0xE0100, 0xE01EF)]
#: Kinds of compatibility form that look like what they stand for.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<small>", "<vertical>")
TOP = 0x110000


@lru_cache(1)
def tables() -> tuple[np.ndarray, ...]:
    """(length, start, pool, combining class, sorted pair keys, composed code points,
    and length, start, pool of full decompositions), all made by rule from the Unicode data but for the fixed values above."""
    to: dict[int, str] = {}
    pairs: dict[int, int] = {}
    ccc = np.zeros(TOP, np.uint8)
    for cp in range(0x80, 0x20000):
        if 0xD800 <= cp < 0xE000 or 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4:
            continue
        ch = chr(cp)
        if c := unicodedata.combining(ch):
            ccc[cp] = c
        d = unicodedata.decomposition(ch)
        if not d:
            if unicodedata.category(ch) == "Zs":
                to[cp] = " "
            continue
        kind = d.split()[0]
        if kind[0] != "<":
            parts = [int(x, 16) for x in d.split()]
            if len(parts) == 2 and unicodedata.normalize("NFC", chr(parts[0]) + chr(parts[1])) == ch:
                pairs[parts[0] << 21 | parts[1]] = cp
            elif unicodedata.normalize("NFC", ch) != ch:
                to[cp] = unicodedata.normalize("NFC", ch)
        elif kind in SAME_LOOK and unicodedata.category(ch)[0] in "LNPSZ":
            to[cp] = " " if unicodedata.category(ch) == "Zs" else unicodedata.normalize("NFKC", ch)
    to[0xB5] = "μ"
    to[0x2126] = "Ω"
    for table in (LOOKALIKES, {k: v * len(k) for k, v in MARKS.items()}):
        for k, v in table.items():
            to |= {ord(a): b for a, b in zip(k, v, strict=True)}
    for a, b in INVISIBLE:
        to |= dict.fromkeys(range(a, b + 1), "")
    length, start, pool = _parts(to)
    keys = np.array(sorted(pairs), np.int64)
    whole = {cp: unicodedata.normalize("NFD", chr(cp)) for cp in pairs.values()}
    return length, start, pool, ccc, keys, np.array([pairs[k] for k in keys.tolist()], np.uint32), *_parts(whole)


def _parts(to: dict[int, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length, start, pool, at = np.ones(TOP, np.int64), np.arange(TOP, dtype=np.int64), [np.arange(TOP, dtype=np.uint32)], TOP
    for cp, s in to.items():
        length[cp], start[cp] = len(s), at
        pool.append(np.array([ord(x) for x in s], np.uint32))
        at += len(s)
    return length, start, np.concatenate(pool)


def _expand(cp: np.ndarray, row: np.ndarray, book: tuple, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    length, start, pool = book
    n = length[cp] if where is None else np.where(where, length[cp], 1)
    ends = np.cumsum(n)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    begin = start[cp] if where is None else np.where(where, start[cp], cp)
    return pool[np.repeat(begin, n) + within], np.repeat(row, n)


def _compose(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ccc, keys, made = tables()[3:6]
    if not ccc[cp].any():
        return cp, row
    # letters that stand before a mark are taken apart, the marks of each letter sorted
    before = np.r_[(ccc[cp[1:]] > 0) & (row[1:] == row[:-1]), False]
    cp, row = _expand(cp, row, tables()[6:9], before & (ccc[cp] == 0))
    cls = ccc[cp]
    cluster = np.cumsum((cls == 0) | np.r_[True, row[1:] != row[:-1]])
    order = np.lexsort((cls, cluster))
    cp, row = cp[order], row[order]
    while True:
        cls = ccc[cp]
        mark = np.flatnonzero(cls > 0)
        base = np.maximum.accumulate(np.where(cls == 0, np.arange(len(cp)), -1))[mark]
        open_ = (base >= 0) & (row[base] == row[mark]) & ((mark - 1 == base) | (cls[mark - 1] != cls[mark]))
        mark, base = mark[open_], base[open_]
        if not len(mark):
            return cp, row
        key = cp[base].astype(np.int64) << 21 | cp[mark]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == key)
        if not len(hit):
            return cp, row
        _, first = np.unique(base[hit], return_index=True)  # one mark a letter at a time
        hit = hit[first]
        cp = cp.copy()
        cp[base[hit]] = made[at[hit]]
        keep = np.ones(len(cp), bool)
        keep[mark[hit]] = False
        cp, row = cp[keep], row[keep]


def canonical_array(col: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(canonical strings, whether each differs from what it was); nulls stay null, with false."""
    col = col.cast(pa.large_string())
    n = len(col)
    valid = np.asarray(col.is_valid())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1]
    size = np.where(valid, np.diff(off), 0)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and n else np.zeros(0, np.uint8)
    if (np.diff(off) != size).any():
        raw = raw[np.repeat(valid, np.diff(off))]
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = (raw & 0xC0) != 0x80
    row = np.repeat(np.arange(n), size)[first]
    new, at = _compose(*_expand(cp, row, tables()[:3]))
    width = 1 + (new > 0x7F) + (new > 0x7FF) + (new > 0xFFFF).astype(np.int64)
    sizes = np.bincount(at, weights=width, minlength=n).astype(np.int64) if n else np.zeros(0, np.int64)
    body = new.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    out_off = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    mask = pa.array(valid).buffers()[1] if not valid.all() else None
    out = pa.LargeStringArray.from_buffers(n, pa.py_buffer(out_off.tobytes()), pa.py_buffer(body), mask)
    # rows that kept their length differ only if a code point does
    n_old, n_new = np.bincount(row, minlength=n), np.bincount(at, minlength=n)
    changed = n_old != n_new
    if n:
        a, b = ~changed[row], ~changed[at]
        changed[row[a][cp[a] != new[b]]] = True
    return out.cast(pa.string()), pa.array(changed)


def canonical_text(df: DataFrame, columns: list[str], suffix: str = "_canonical") -> DataFrame:
    """Add, for each text column c, c+suffix with the text in one form and
    c+suffix+'_changed', whether a character of it was no usual one.

    One form: full-width and other same-looking forms become the plain ones,
    non-breaking and wide spaces a blank, dashes and minus signs a hyphen, letters
    of other scripts that look Latin the Latin ones, micro sign the Greek letter;
    marks are composed with their letters; invisible characters go. Greek
    descriptors that look like no Latin letter stay, as do super- and subscripts.

    Null gives null with false, an empty text an empty one with false. Text of
    any length is taken whole. Ties and repeated rows have no influence. Further
    columns stay as they are; one with a new column's name is an error that says so.
    """
    new = [f"{c}{suffix}{e}" for c in columns for e in ("", "_changed")]
    if clash := set(new) & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    fields = list(df.schema.fields)
    for c in columns:
        fields += [T.StructField(c + suffix, T.StringType()), T.StructField(f"{c}{suffix}_changed", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = list(b.columns)
            for c in columns:
                arrays += canonical_array(b.column(b.schema.get_field_index(c)))
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names, *new])

    return df.mapInArrow(run, T.StructType(fields))


def canonical_values(parts: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """field_name, row_id, pos, value, canonical, odd for each value of (table, id
    column, column), where the column holds strings or arrays of strings (pos counts
    from 1). Runs of blanks and tabs become one blank in ``canonical``, outer ones
    go; they alone do not make a value ``odd``. Null values give no rows."""
    rows = None
    for df, key, col in parts:
        if df.schema[col].dataType.typeName() == "array":
            one = df.select(F.col(key).cast("long").alias("row_id"), F.posexplode(col).alias("i", "value"))
        else:
            one = df.select(F.col(key).cast("long").alias("row_id"), F.lit(0).alias("i"), F.col(col).alias("value"))
        one = one.where("value is not null").select(F.lit(col).alias("field_name"), "row_id", (F.col("i") + 1).cast("int").alias("pos"), "value")
        rows = one if rows is None else rows.unionByName(one)
    out = canonical_text(rows, ["value"])
    form = F.trim(F.regexp_replace("value_canonical", r"[ \t]+", " "))
    return out.select("field_name", "row_id", "pos", "value", form.alias("canonical"), F.col("value_canonical_changed").alias("odd"))

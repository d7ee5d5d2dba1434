"""Duplicates hidden by formatting differences (problem 7).

Byte-identical raw rows collapse first, with counts; only the distinct survivors
are canonicalised; a second grouping on the full canonical text sums the counts.
Both groupings aggregate partially before they shuffle, so that a set that holds
a third of all rows is one row per task by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_unique


def letters_and_digits(c: Column) -> Column:
    """Lower-case letters and digits of any script, in their order; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]+", ""))


def canonical_key(columns: list[str]) -> Column:
    """The fields' letters and digits as sorted array, so that fields may have changed places."""
    return F.array_sort(F.array(*[letters_and_digits(F.col(c)) for c in columns]))


def _digest(columns: list[str]) -> Column:
    """128 bits of the raw fields, null apart from every text."""
    return F.unhex(F.md5(F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in columns])))


def _raw(df: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    named = [f"__c{i}" for i in range(len(columns))]
    rows = df.select(F.col(id_col).alias("__id"), *[F.col(c).alias(n) for c, n in zip(columns, named, strict=True)])
    raw = rows.groupBy(*named).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    return raw.select("__first", "__n", _digest(named).alias("__form"), canonical_key(named).alias("__key"))


def collapse_copies(df: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """One row for each set of records that are the same up to letter case,
    punctuation, blanks and order of ``columns``: first_id (smallest id), n_copies
    (records of the set, itself included), n_spellings (distinct raw forms).

    Null counts as empty; records empty in all ``columns`` are one set. Letters are
    compared as they are, but for case. Repeated ids are counted as rows. Further
    columns have no influence, whatever their names; an empty table gives none.
    """
    sets = _raw(df, columns, id_col).groupBy("__key")
    return sets.agg(F.min("__first").alias("first_id"), F.sum("__n").alias("n_copies"), F.count(F.lit(1)).alias("n_spellings")).drop("__key")


def copy_members(df: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """first_id, copy_id for each record but the first of its set.

    The sets come from the same two groupings. The distinct raw forms of sets of
    two or more learn their first id, and records meet it by a 128-bit digest of
    their raw fields, in merge joins whose hot partitions split over tasks.
    """
    raw = _raw(df, columns, id_col)
    sets = raw.groupBy("__key").agg(F.min("__first").alias("first_id"), F.sum("__n").alias("__all")).where("__all > 1")
    forms = join_unique(raw.select("__form", "__key"), sets.select("__key", "first_id"), "__key", "inner").select("__form", "first_id")
    rows = df.select(F.col(id_col).alias("copy_id"), _digest(columns).alias("__form"))
    return join_unique(rows, forms, "__form", "inner").where("copy_id <> first_id").select("first_id", "copy_id")

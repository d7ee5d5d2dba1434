"""Joins of many rows to one row per key when a key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def join_unique(big: DataFrame, small: DataFrame, keys: str | list[str], how: str = "left") -> DataFrame:
    """Join ``big`` to ``small``, which has at most one row per key.

    Written as a merge join on purpose: it streams the rows of ``big`` past one
    row of ``small``, so a hot key costs no memory, and as nothing downstream
    asks for its partitioning, the adaptive skew join splits the hot partition
    of ``big`` over tasks and sends each the one matching row. Nothing is
    broadcast whose size is not known.
    """
    return big.join(small.hint("merge"), keys, how)


def ranked(df: DataFrame, by: list[str], order: list[str | Column], slice_: Column, name: str) -> DataFrame:
    """Add ``name``: the row's number, from 1, within its group in ``order``.

    Rows are numbered in two levels, so that a group that holds a third of all rows
    is no single task: ``slice_`` cuts a group into pieces that follow each other in
    ``order`` (it never falls as the order goes on), rows are numbered within a
    piece, and a piece learns how many rows come before it from one row a piece.
    """
    rows = df.withColumn("__slice", slice_)
    sizes = rows.groupBy(*by, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*by, "__slice").orderBy(*order))
    keys = [*by, "__slice"]
    a, b = rows.withColumn("__own", own), sizes
    on = None
    for k in keys:
        b = b.withColumnRenamed(k, f"__b_{k}")
        c = F.col(k).eqNullSafe(F.col(f"__b_{k}"))
        on = c if on is None else on & c
    out = a.join(b, on, "left").withColumn(name, (F.col("__before") + F.col("__own")).cast("long"))
    return out.drop("__slice", "__own", "__before", *[f"__b_{k}" for k in keys])


def hash_slice(key: Column, digits: int = 3) -> Column:
    """A piece of the order of md5(key): its first hex digits."""
    return F.substring(F.md5(key), 1, digits)

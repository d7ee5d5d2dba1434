"""Reading order: numbering, forward fill and links of units, in two levels.

A paper may hold a large part of all rows, so no window spans a whole paper: rows
are ordered within a page, and pages are linked by one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def forward_fill(df: DataFrame, group: str, page: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Add ``name``: the last non-null ``value`` at or before each row of its group in
    the order of ``page``, then ``order``. Null before the first; ties as ``order`` says."""
    rows = df.withColumn("__v", value)
    within = Window.partitionBy(group, page).orderBy(*order)
    rows = rows.withColumn("__own", F.last("__v", True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    last = rows.where("__v is not null").groupBy(group, page).agg(F.max_by("__v", F.struct(*order)).alias("__last"))
    pages = df.select(group, page).distinct().join(last, [group, page], "left")
    before = Window.partitionBy(group).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    carried = pages.select(group, page, F.last("__last", True).over(before).alias("__carried"))
    return rows.join(carried, [group, page]).withColumn(name, F.coalesce("__own", "__carried")).drop("__v", "__own", "__carried")


def neighbours(df: DataFrame, group: str, page: str, order: list[str], key: str) -> DataFrame:
    """Add prev_key and next_key: ``key`` of the rows before and after in the group's order."""
    within = Window.partitionBy(group, page).orderBy(*order)
    rows = df.withColumn("__p", F.lag(key).over(within)).withColumn("__n", F.lead(key).over(within))
    ends = df.groupBy(group, page).agg(F.min_by(key, F.struct(*order)).alias("__first"), F.max_by(key, F.struct(*order)).alias("__last"))
    by = Window.partitionBy(group).orderBy(page)
    ends = ends.select(group, page, F.lag("__last").over(by).alias("__pl"), F.lead("__first").over(by).alias("__nf"))
    return rows.join(ends, [group, page]).withColumn("prev_key", F.coalesce("__p", "__pl")).withColumn("next_key", F.coalesce("__n", "__nf")).drop("__p", "__n", "__pl", "__nf")

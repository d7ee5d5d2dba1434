"""Connected components of a membership table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .skew import join_unique


def connected_components(members: DataFrame, member: str, key: str, max_rounds: int = 100) -> DataFrame:
    """member -> component (its smallest member) where members that share a key,
    directly or through others, are connected. Null keys connect nothing; null
    members are dropped. Repeated rows have no influence; an empty table gives none.

    Each round every key takes its smallest root, every root the smallest of its
    keys, roots follow their root once more, and the table shrinks to the distinct
    (root, key) pairs of keys that still see several roots. Minima aggregate
    partially, so a key that holds a third of all rows is one row per task in the
    shuffle; the join that hands a key's minimum back streams, and its hot
    partition is split. Nothing of the size of the data reaches the driver.
    """
    rows = members.select(F.col(member).alias("m"), F.col(key).alias("k")).where("m is not null").distinct()
    rows = settle(rows, "members")
    labels = settle(rows.select("m").distinct().withColumn("root", F.col("m")), "labels")
    pairs = rows.where("k is not null").select(F.col("m").alias("root"), "k")
    for _ in range(max_rounds):
        low = pairs.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("k", "low")
        live = settle(join_unique(pairs, low, "k", "inner"), "pairs")
        if live.isEmpty():
            break
        step = live.groupBy("root").agg(F.min("low").alias("to"))
        # follow once more: the target's own target, where it has a smaller one
        onward = step.select(F.col("root").alias("to"), F.col("to").alias("next"))
        step = settle(join_unique(step, onward, "to").select("root", F.coalesce("next", "to").alias("to")), "step")
        labels = settle(join_unique(labels, step, "root").select("m", F.coalesce("to", "root").alias("root")), "labels")
        pairs = join_unique(live.select("root", "k"), step, "root").select(F.coalesce("to", "root").alias("root"), "k").distinct()
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels.select(F.col("m").alias(member), F.col("root").alias("component"))

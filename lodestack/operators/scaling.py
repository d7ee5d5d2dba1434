"""Exact imputation, scaling and guards for feature matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settle

#: Query vectors handed to every task at once, and of those, compared at once.
QUERY_BLOCK, INNER_BLOCK = 32_768, 2048
#: Pieces that the range of a group's values is cut into for exact quantiles.
PIECES = 4096


def long_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, dim (from 0), x for each element of a vector."""
    return df.select(key, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """``by``, q (array): quantiles of ``value`` by linear interpolation, exact, without
    holding a group's values in one task. Nulls and NaN have no part; a group without
    values gives no row.

    Rows are counted by distinct value first. A group's range is cut into PIECES, whose
    counts tell which piece holds the wanted ranks, and only the distinct values of
    those pieces are sorted.
    """
    keys = [*by, "__all"]
    x = F.col(value).cast("double")
    counts = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by, F.lit(0).alias("__all"), x.alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    counts = settle(counts, "values")
    ends = counts.groupBy(*keys).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.sum("__n").alias("__total"))
    width = F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    piece = F.least(F.lit(PIECES - 1), F.floor((F.col("__x") - F.col("__lo")) / width * PIECES)).cast("int")
    cut = counts.join(ends, keys).withColumn("__piece", F.coalesce(piece, F.lit(0)))
    sizes = cut.groupBy(*keys, "__piece").agg(F.sum("__n").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("__before", F.coalesce(before, F.lit(0)))
    at = [(i, float(p)) for i, p in enumerate(shares)]
    want = ends.select(*keys, "__total", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in at])).alias("w"))
    want = want.select(*keys, "w.i", (F.col("w.p") * (F.col("__total") - 1)).alias("place"))
    want = want.select(*keys, "i", "place", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).distinct()
    want = want.join(sizes, keys).where("rank >= __before and rank < __before + __size")
    inside = Window.partitionBy(*keys, "__piece").orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    values = cut.join(want.select(*keys, "__piece", "__before").distinct(), [*keys, "__piece"])
    values = values.withColumn("__from", F.col("__before") + F.coalesce(F.sum("__n").over(inside), F.lit(0))).select(*keys, "__piece", "__x", "__from", (F.col("__from") + F.col("__n")).alias("__to"))
    got = want.join(values, [*keys, "__piece"]).where("rank >= __from and rank < __to")
    one = got.groupBy(*keys, "i", "place").agg(F.min("__x").alias("a"), F.max("__x").alias("b"))
    one = one.withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place")))
    return one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda z: z["q"]).alias("q")).drop("__all")


def impute_median(df: DataFrame, value: str) -> DataFrame:
    """Nulls of ``value`` replaced by the exact median of the rest."""
    med = exact_quantiles(df, [], value, [0.5]).select(F.col("q")[0].alias("__m"))
    # one row, or none where all are null
    med = df.sparkSession.range(1).select(F.lit(1)).join(med, F.lit(True), "left").select("__m")
    return df.join(F.broadcast(med)).withColumn(value, F.coalesce(value, "__m")).drop("__m")


def standard_scale(long: DataFrame) -> DataFrame:
    """(x - mean) / population deviation for each dim; a constant dim is only centred."""
    s = long.groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return long.join(s, "dim").withColumn("z", (F.col("x") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).drop("m", "s")


def robust_scale(long: DataFrame) -> DataFrame:
    """(x - median) / interquartile range for each dim, exact percentiles; range 0 counts as 1."""
    q = exact_quantiles(long, ["dim"], "x", [0.25, 0.5, 0.75])
    r = F.col("q")[2] - F.col("q")[0]
    return long.join(q, "dim").withColumn("z", (F.col("x") - F.col("q")[1]) / F.when(r == 0, 1.0).otherwise(r)).drop("q")


def varying_columns(df: DataFrame) -> list[str]:
    """Columns with more than one value, null counting as one: one pass over the table."""
    row = df.agg(*[F.max(F.col(c).isNull()).alias(f"n:{c}") for c in df.columns], *[F.min(c).alias(f"a:{c}") for c in df.columns], *[F.max(c).alias(f"b:{c}") for c in df.columns]).first()
    return [c for c in df.columns if row[f"a:{c}"] != row[f"b:{c}"] or (row[f"n:{c}"] and row[f"a:{c}"] is not None)]


def cosine_top_k(df: DataFrame, key: str, vector: str, is_query, k: int) -> DataFrame:
    """query_id, match_id, cosine, rank: the k nearest others of each query, exact.

    Queries go to the tasks in blocks of QUERY_BLOCK; a task multiplies its rows
    with the block and keeps its own k best for each query over all its rows, and
    only those are shuffled. Ties go to the smaller id. Zero and null vectors match nothing.
    """
    spark = df.sparkSession
    queries = df.where(is_query).where(F.col(vector).isNotNull()).select(key, vector)
    low, n = None, queries.count()
    out = None
    for _ in range(max(1, -(-n // QUERY_BLOCK))):
        block = (queries if low is None else queries.where(F.col(key) > low)).orderBy(key).limit(QUERY_BLOCK).collect()
        if not block:
            break
        low = block[-1][0]
        ids = np.array([r[0] for r in block])
        q = np.array([r[1] for r in block], float)
        shared = spark.sparkContext.broadcast((ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            # the k best of each query so far, over all batches of the task
            best, who = np.full((len(ids), k), -9.0), np.full((len(ids), k), np.iinfo(np.int64).max)
            for f in frames:
                f = f[f[vector].notna()]
                if not len(f):
                    continue
                own, m = f[key].to_numpy(np.int64), np.array(f[vector].tolist(), float)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                for at in range(0, len(ids), INNER_BLOCK):
                    part = slice(at, at + INNER_BLOCK)
                    sim = q[part] @ m.T
                    sim[ids[part, None] == own[None, :]] = -9
                    sims = np.c_[best[part], sim]
                    names = np.c_[who[part], np.broadcast_to(own, sim.shape)]
                    order = np.lexsort((names, -np.round(sims, 9)), axis=1)[:, :k]
                    best[part], who[part] = np.take_along_axis(sims, order, 1), np.take_along_axis(names, order, 1)
            ok = best > -9
            yield pd.DataFrame({"query_id": np.repeat(ids, k)[ok.ravel()], "match_id": who[ok], "cosine": best[ok]})

        one = df.select(key, vector).mapInPandas(run, "query_id long, match_id long, cosine double")
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "match_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

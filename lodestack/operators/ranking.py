"""Rank aggregation: Borda scores, average ranks, Kendall's tau, bootstrap intervals."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Replicates of a group that one task draws at a time.
BLOCK = 50


def rank_items(scores: DataFrame, by: list[str], item: str, score: str) -> DataFrame:
    """Add rank (1 is best; ties by item), k and borda = (k - rank) / (k - 1)."""
    w = Window.partitionBy(*by)
    out = scores.withColumn("rank", F.row_number().over(w.orderBy(F.desc(score), item))).withColumn("k", F.count(F.lit(1)).over(w))
    return out.withColumn("borda", (F.col("k") - F.col("rank")) / F.nullif(F.col("k") - 1, F.lit(0)))


def average_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Add avg_rank: ranks by descending value, ties sharing their mean."""
    w = Window.partitionBy(*by)
    return df.withColumn("avg_rank", F.rank().over(w.orderBy(F.desc(value))) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0)


def ranking_classes(ranks: DataFrame, model: str, trial: str, item: str) -> DataFrame:
    """model, ranking (items in order), m: distinct rankings with their number of trials.
    There are at most k! of them, however many trials there are."""
    order = ranks.groupBy(model, trial).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda x: x[item]).alias("ranking"))
    return order.groupBy(model, "ranking").agg(F.count(F.lit(1)).alias("m"))


def tau_of(a, b):
    """Kendall's tau of two permutations of the same items, as an array expression."""
    k = F.size(a)
    pos = lambda x: F.array_position(b, x)
    idx = F.sequence(F.lit(1), k)
    concordant = F.aggregate(
        idx,
        F.lit(0),
        lambda acc, i: acc + F.aggregate(idx, F.lit(0), lambda s, j: s + F.when((j > i) & (pos(F.element_at(a, i.cast("int"))) < pos(F.element_at(a, j.cast("int")))), 1).when(j > i, -1).otherwise(0)),
    )
    return concordant / (k * (k - 1) / 2)


def pairwise_tau(classes: DataFrame, model: str) -> DataFrame:
    """model, ranking_a, ranking_b, n_pairs, tau over pairs of trials: pairs of
    distinct rankings, each standing for all pairs of its trials."""
    a = classes.select(model, F.array_join("ranking", ">").alias("ranking_a"), F.col("ranking").alias("ra"), F.col("m").alias("ma"))
    b = classes.select(model, F.array_join("ranking", ">").alias("ranking_b"), F.col("ranking").alias("rb"), F.col("m").alias("mb"))
    # both sides hold at most k! rows a model
    p = a.join(b, model).where("ranking_a <= ranking_b")
    n = F.when(F.col("ranking_a") == F.col("ranking_b"), (F.col("ma") * (F.col("ma") - 1) / 2).cast("long")).otherwise(F.col("ma") * F.col("mb"))
    return p.withColumn("n_pairs", n).where("n_pairs > 0").select(model, "ranking_a", "ranking_b", "n_pairs", tau_of(F.col("ra"), F.col("rb")).alias("tau"))


def tau_b(ranks: DataFrame, unit: str, item: str, value: str) -> DataFrame:
    """unit_a, unit_b, tau (tau-b, ties counted) between the units' values over shared items."""
    a, b = ranks.select(F.col(unit).alias("u"), F.col(item).alias("i"), F.col(value).alias("x")), ranks.select(F.col(unit).alias("u"), F.col(item).alias("j"), F.col(value).alias("y"))
    d = a.join(b, "u").where("i < j").select("u", "i", "j", F.signum(F.col("x") - F.col("y")).alias("s"))
    p = d.select(F.col("u").alias("unit_a"), "i", "j", F.col("s").alias("sa")).join(d.select(F.col("u").alias("unit_b"), "i", "j", F.col("s").alias("sb")), ["i", "j"]).where("unit_a < unit_b")
    num, na, nb = F.sum(F.col("sa") * F.col("sb")), F.sum(F.abs("sa")), F.sum(F.abs("sb"))
    return p.groupBy("unit_a", "unit_b").agg((num / F.sqrt(F.nullif(na * nb, F.lit(0.0)))).alias("tau"))


def bootstrap_mean(df: DataFrame, by: list[str], order: str, value: str, replicates: int, seed: str) -> DataFrame:
    """mean, ci_lower, ci_upper (2.5 and 97.5 percent, linear) of the resampled mean.
    Draw i of replicate r takes the row numbered by a hash of seed, group, r and i,
    so the result depends on the data only."""
    packed = df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias("values"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    # a group's values go along with blocks of replicates, so that no draw is a row of a shuffle
    blocks = packed.select(*by, "n", "values", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // BLOCK))).alias("block")).repartition(df.sparkSession.sparkContext.defaultParallelism * 4, *by, "block")
    first = F.col("block") * BLOCK + 1
    draws = blocks.select(*by, "n", "values", F.explode(F.sequence(first, F.least(first + BLOCK - 1, F.lit(replicates)))).alias("r")).select(*by, "n", "values", "r", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    h = F.md5(F.concat_ws(":", F.lit(seed), *by, "r", "i"))
    drawn = (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % F.col("n")).cast("int")
    means = draws.groupBy(*by, "r").agg(F.avg(F.get("values", drawn)).alias("m"))
    ci = means.groupBy(*by).agg(F.percentile("m", 0.025).alias("ci_lower"), F.percentile("m", 0.975).alias("ci_upper"))
    return ci.join(packed.select(*by, "mean"), by)


def bootstrap_tau(classes: DataFrame, model: str, replicates: int, seed: int) -> DataFrame:
    """model, mean_tau, ci_lower, ci_upper (2.5 and 97.5 percent, linear), n_trials: the
    mean tau over pairs of trials, and of resampled trials, where a trial drawn twice
    is a pair of tau 1. ``classes`` are those of ranking_classes: at most k! a model,
    so drawing trials is drawing multinomial counts of classes. For items a, b let s
    be 1 or -1 as a trial ranks them; the taus of all ordered pairs of trials, each
    with itself too, then sum to the sum over (a, b) of (sum of s)^2, by k (k - 1) / 2."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        items = sorted(f["ranking"].iloc[0])
        if any(sorted(x) != items for x in f["ranking"]):
            raise ValueError(f"rankings of {f[model].iloc[0]} hold different items")
        f = f.assign(key=[">".join(x) for x in f["ranking"]]).sort_values("key")
        place = np.array([[list(x).index(i) for i in items] for x in f["ranking"]])
        a, b = np.triu_indices(len(items), 1)
        signs, m = np.sign(place[:, b] - place[:, a]).astype(float), f["m"].to_numpy(np.int64)
        n = int(m.sum())
        mean = lambda counts: (((counts @ signs) ** 2).sum(1) / len(a) - n) / (n * (n - 1.0))
        if n < 2 or not len(a):
            return pd.DataFrame({model: f[model].iloc[:1], "mean_tau": [None], "ci_lower": [None], "ci_upper": [None], "n_trials": [n]})
        rng = np.random.default_rng([seed, zlib.crc32(str(f[model].iloc[0]).encode())])
        # 500 at a time: counts of 5040 classes are 20 MB
        means = np.concatenate([mean(rng.multinomial(n, m / n, min(500, replicates - at))) for at in range(0, replicates, 500)])
        lower, upper = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame({model: f[model].iloc[:1], "mean_tau": mean(m[None, :]), "ci_lower": [lower], "ci_upper": [upper], "n_trials": [n]})

    kind = classes.schema[model].dataType.simpleString()
    return classes.groupBy(model).applyInPandas(run, f"{model} {kind}, mean_tau double, ci_lower double, ci_upper double, n_trials long")


def check_rankings(df: DataFrame, model: str, trial: str, item: str, rank: str, k: str, borda: str) -> DataFrame:
    """rule, n: keys (model, trial, item) that repeat, trials that don't hold ``k``
    different items, rows whose score isn't (k - rank) / (k - 1)."""
    wrong = (F.abs(F.col(borda) - (F.col(k) - F.col(rank)) / (F.col(k) - 1)) > 1e-8).cast("int")
    by_key = df.groupBy(model, trial, item).agg(F.count(F.lit(1)).alias("__n"), F.sum(wrong).alias("__w"), F.max(k).alias("__k"))
    by_trial = by_key.groupBy(model, trial).agg(F.count_if(F.col("__n") > 1).alias("a"), (F.count(F.lit(1)) != F.max("__k")).cast("int").alias("b"), F.sum("__w").alias("c"))
    total = by_trial.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "abc"])
    return total.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(c).alias("n")) for r, c in (("repeated_key", "a"), ("missing_item", "b"), ("score", "c"))])).alias("x")).select("x.rule", "x.n")


def select_valid(records: DataFrame, wanted: DataFrame, keys: list[str], valid, ranking: str) -> DataFrame:
    """``keys``, n, verdict for each wanted key: 'ok' with exactly one valid record,
    'missing', 'repeated' (several that agree) or 'conflicting'."""
    g = records.where(valid).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(ranking).alias("__a"), F.max(ranking).alias("__b"))
    out = wanted.join(g, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(*keys, "n", F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "ok").when(F.col("__a") == F.col("__b"), "repeated").otherwise("conflicting").alias("verdict"))

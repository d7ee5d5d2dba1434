"""Choosing and dealing out groups: interleaving by class, stratified folds, grouped holdout."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import hash_slice, join_unique, ranked


def interleave(df: DataFrame, cls: str, key: str, limit: int | None = None) -> DataFrame:
    """Add key = (rank - 0.5) / rows of the class, rows ranked by md5 of ``key`` within
    their class: ordered by it, classes alternate in proportion. With ``limit``, each
    class keeps its share of so many rows, rounded half to even, at least one."""
    sizes = df.groupBy(F.col(cls).alias("__cls")).agg(F.count(F.lit(1)).alias("__n"))
    if limit is not None:
        total = df.agg(F.count(F.lit(1)).alias("__all"))
        sizes = sizes.join(F.broadcast(total)).withColumn("__n", F.least("__n", F.greatest(F.lit(1), F.bround(limit * F.col("__n") / F.col("__all"), 0).cast("long")))).drop("__all")
    rows = ranked(df, [cls], [F.md5(key), F.col(key)], hash_slice(F.col(key)), "__rank")
    out = rows.join(sizes, F.col(cls).eqNullSafe(F.col("__cls"))).where(F.col("__rank") <= F.col("__n"))
    return out.withColumn("key", (F.col("__rank") - 0.5) / F.col("__n")).drop("__cls", "__n", "__rank")


def deal_folds(profiles: list[tuple[int, int, int]], k: int) -> dict[tuple[int, int], list[int]]:
    """How many of the n groups of each profile (rows of class 0, rows of class 1, n)
    go to each of ``k`` folds. Whole k-ths go to every fold; the rest are placed one
    by one, those of most uneven classes first, where the class shares of the folds
    spread least, then where the fold is smallest."""
    total = np.maximum(1.0, np.array([sum(a * n for a, _, n in profiles), sum(b * n for _, b, n in profiles)], float))
    load = np.zeros((k, 2))
    out: dict[tuple[int, int], list[int]] = {}
    for a, b, n in sorted(profiles, key=lambda p: (-np.std([p[0], p[1]]), p)):
        whole, rest = divmod(n, k)
        out[a, b] = [whole] * k
        load += np.array([a, b], float) * whole
        for _ in range(rest):
            trial = [(round(float(np.std(np.where(np.arange(k)[:, None] == f, load + [a, b], load) / total, axis=0).mean()), 12), float(load[f].sum()), f) for f in range(k)]
            f = min(trial)[2]
            load[f] += [a, b]
            out[a, b][f] += 1
    return out


def stratified_folds(rows: DataFrame, group: str, label: str, k: int) -> DataFrame:
    """``group`` and fold (0 to k - 1): groups stay whole, folds are alike in size and in
    the shares of the 0/1 ``label`` (null counts as 0).

    Groups of the same number of rows of each class are one profile; profiles are few
    whatever the number of groups (g different ones need of the order of g^1.5 rows),
    and only they reach the driver. Which groups of a profile go where is decided by
    hash, so repeated runs and other partitionings agree.
    """
    y = F.coalesce(F.col(label), F.lit(0))
    g = rows.groupBy(group).agg(F.sum((y == 0).cast("int")).alias("__a"), F.sum((y == 1).cast("int")).alias("__b"))
    profiles = [tuple(r) for r in g.groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("n")).collect()]
    spans = []
    for (a, b), counts in deal_folds(profiles, k).items():
        lo = 0
        for fold, n in enumerate(counts):
            if n:
                spans.append((a, b, lo, lo + n, fold))
                lo += n
    plan = rows.sparkSession.createDataFrame(spans, "__a long, __b long, __lo long, __hi long, fold int")
    ranks = ranked(g, ["__a", "__b"], [F.md5(group), F.col(group)], hash_slice(F.col(group)), "__rank")
    return ranks.join(plan, ["__a", "__b"]).where("__rank > __lo and __rank <= __hi").select(group, "fold")


def grouped_holdout(rows: DataFrame, group: str, label: str, share: float = 0.2, tries: int = 50_000, seed: int = 42) -> DataFrame:
    """``group`` and held (boolean): whole groups set apart whose rows are about ``share``
    of all and whose rate of the 0/1 ``label`` is near that of all.

    ``tries`` random orders of the groups are tried, parted over the tasks: a group
    joins if it doesn't pass the target, or while three quarters of it are not
    reached; both sides need both classes. The best by |rows - target| / all +
    |rate - rate of all| wins, then the smaller try. Only the winner's number comes
    back to the driver; each task holds the sizes of all groups, two numbers each.
    """
    spark = rows.sparkSession
    g = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col(label), F.lit(0)).cast("long")).alias("y")).orderBy(group)
    table = g.toPandas()
    n, y = table["n"].to_numpy(np.int64), table["y"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((n, y))
    total, ones = int(n.sum()), int(y.sum())
    target = int(np.round(total * share))

    def chosen(t: int, n: np.ndarray) -> list[int]:
        picked, have = [], 0
        for i in np.random.default_rng([seed, t]).permutation(len(n)):
            if have + n[i] <= target or have < target * 0.75:
                picked.append(int(i))
                have += int(n[i])
            if have >= target:
                break
        return picked

    def run(frames):
        n, y = shared.value
        for f in frames:
            best = None
            for t in f["id"]:
                at = chosen(int(t), n)
                rows_, ones_ = int(n[at].sum()), int(y[at].sum())
                if 0 < ones_ < rows_ and 0 < ones - ones_ < total - rows_:
                    score = abs(rows_ - target) / total + abs(ones_ / rows_ - ones / total)
                    if best is None or (score, t) < best:
                        best = (score, int(t))
            if best:
                yield pd.DataFrame([best], columns=["score", "t"])

    won = spark.range(tries).mapInPandas(run, "score double, t long").agg(F.min(F.struct("score", "t")).alias("b")).first()["b"] if total else None
    if won is None:
        raise ValueError("no grouped holdout with both classes on both sides")
    held = set(chosen(won["t"], n))
    pick = spark.createDataFrame([(str(k),) for k in table[group].iloc[sorted(held)]], "k string")
    mark = pick.select(F.col("k").cast(rows.schema[group].dataType).alias(group), F.lit(True).alias("held"))
    return join_unique(g.select(group), mark, group).select(group, F.coalesce("held", F.lit(False)).alias("held"))

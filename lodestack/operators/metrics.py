"""Classification metrics, thresholds and resumable work plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0))


def binary_metrics(df: DataFrame, by: list[str], truth: str, pred: str) -> DataFrame:
    """n, accuracy, macro_f1 of 0/1 columns by group: one pass of conditional counts.
    A label that is neither true nor predicted anywhere has no part in the mean."""
    t, p = F.col(truth), F.col(pred)
    c = lambda x: F.sum(x.cast("long"))
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), c((t == 1) & (p == 1)).alias("tp"), c((t == 0) & (p == 1)).alias("fp"), c((t == 1) & (p == 0)).alias("fn"), c((t == 0) & (p == 0)).alias("tn")
    )
    one, zero = _f1(F.col("tp"), F.col("fp"), F.col("fn")), _f1(F.col("tn"), F.col("fn"), F.col("fp"))
    has1, has0 = (F.col("tp") + F.col("fp") + F.col("fn") > 0).cast("int"), (F.col("tn") + F.col("fn") + F.col("fp") > 0).cast("int")
    return g.select(*by, "n", "tp", "fp", "fn", "tn", ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"), ((one * has1 + zero * has0) / (has1 + has0)).alias("macro_f1"))


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Counts and row shares of the four cells of a 0/1 confusion matrix, zero cells kept."""
    grid = df.sparkSession.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)], "truth int, pred int")
    n = df.groupBy(F.col(truth).cast("int").alias("truth"), F.col(pred).cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    cells = grid.join(n, ["truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    row = F.sum("n").over(Window.partitionBy("truth"))
    return cells.withColumn("share", F.coalesce(F.col("n") / F.nullif(row, F.lit(0)), F.lit(0.0)))


def threshold_sweep(df: DataFrame, truth: str, score: str, steps: int = 181, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """threshold, macro_f1 at each of ``steps`` thresholds (predicted 1 where score >= threshold).

    Rows are counted once into the interval between thresholds that their score
    falls in; running sums over those few intervals give all confusion counts.
    """
    t = [round(lo + (hi - lo) * i / (steps - 1), 6) for i in range(steps)]
    # how many thresholds the score reaches: by arithmetic, put right by the thresholds on both sides
    grid_of = F.array(F.lit(float("-inf")), *[F.lit(x) for x in t], F.lit(float("inf")))
    near = F.greatest(F.lit(0), F.least(F.lit(steps), F.floor((F.col(score) - lo) / ((hi - lo) / (steps - 1))).cast("int") + 1))
    reach = F.when(F.col(score) < F.get(grid_of, near), near - 1).when(F.col(score) >= F.get(grid_of, near + 1), near + 1).otherwise(near)
    reach = F.when(F.isnan(score), steps).otherwise(F.coalesce(reach, F.lit(0)))
    hist = df.groupBy(reach.alias("k")).agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.sum((1 - F.col(truth)).cast("long")).alias("neg"))
    grid = df.sparkSession.createDataFrame([(i, t[i - 1] if i else None) for i in range(steps + 1)], "k int, threshold double")
    w = Window.orderBy("k")
    g = grid.join(hist, "k", "left").fillna(0, ["pos", "neg"])
    g = g.withColumn("tp", F.sum("pos").over(w.rowsBetween(0, Window.unboundedFollowing))).withColumn("fp", F.sum("neg").over(w.rowsBetween(0, Window.unboundedFollowing)))
    g = g.withColumn("fn", F.sum("pos").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("tn", F.sum("neg").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    g = g.where("threshold is not null").fillna(0, ["fn", "tn"])
    return g.select("threshold", ((_f1(F.col("tp"), F.col("fp"), F.col("fn")) + _f1(F.col("tn"), F.col("fn"), F.col("fp"))) / 2).alias("macro_f1"))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, by partial aggregation rather than a sort of each key's rows."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def remaining(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned work that is not done yet."""
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def class_probability(tokens: Column) -> Column:
    """struct(prediction, p_zero, p_one, mass, error) of array<struct<token,logprob>>:
    probabilities of the class tokens '0' and '1', blanks around a token aside, summed
    over its spellings and conditional on either. A class without token gets the least
    log-probability of all; without both, the error says so and the rest is null. At
    equal probability class 1 is predicted."""
    of = lambda c: F.filter(tokens, lambda x: F.trim(x["token"]) == c)
    floor = F.exp(F.array_min(F.transform(tokens, lambda x: x["logprob"])))
    raw = lambda c: F.when(F.size(of(c)) > 0, F.aggregate(of(c), F.lit(0.0), lambda a, x: a + F.exp(x["logprob"]))).otherwise(floor)
    ok = (F.size(of("0")) > 0) | (F.size(of("1")) > 0)
    zero, one = raw("0"), raw("1")
    return F.struct(
        F.when(ok, (one >= zero).cast("int")).alias("prediction"), F.when(ok, zero / (zero + one)).alias("p_zero"), F.when(ok, one / (zero + one)).alias("p_one"), F.when(ok, zero + one).alias("mass"), F.when(ok, F.lit(None)).otherwise("no class token").alias("error")
    )

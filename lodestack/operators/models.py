"""Grouped model selection on Spark ML: two feature blocks, scaling, PCA by explained
variance, random forest and linear SVM grids, macro-F1, out-of-fold scores, Platt
scaling, thresholds, permutation importance, saved bundles.

Kernel SVMs, tree SHAP, UMAP and chemistry toolkits have no counterpart here.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .metrics import binary_metrics, threshold_sweep
from .scaling import exact_quantiles
from .skew import ranked

#: Trees of a forest; depth 30 is the deepest that Spark grows, and stands for no limit.
TREES = 300


def pca_features(df: DataFrame, features: str, share: float):
    """(function that projects a frame, number of components) for the fewest components
    whose variances pass ``share`` of the total variance; data are centred."""
    scaler = StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="__c").fit(df)
    size = len(scaler.mean)
    model = PCA(k=size, inputCol="__c", outputCol="__p").fit(scaler.transform(df))
    cum = np.cumsum(model.explainedVariance.toArray())
    k = min(size, int(np.searchsorted(cum, share, side="right") + 1))

    def project(x: DataFrame) -> DataFrame:
        return model.transform(scaler.transform(x)).withColumn(features, array_to_vector(F.slice(vector_to_array("__p"), 1, k))).drop("__c", "__p")

    return project, k


def pca_names(prefix: str, k: int) -> list[str]:
    return [f"{prefix}_PC{i}" for i in range(1, k + 1)]


def prepare_blocks(train: DataFrame, plain: list[str], block: list[str], prefix: str, scale: bool = False, share: float | None = None) -> tuple[Callable[[DataFrame], DataFrame], list[str]]:
    """(function that adds ``features``, names of the features): ``plain`` columns with
    nulls and NaN replaced by the median, then ``block`` columns likewise, scaled to
    mean 0 and population deviation 1 if asked, and projected on the components that
    pass ``share`` of their variance if asked. Everything is fitted to ``train``."""
    cols = [*plain, *block]
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in cols])).alias("z")).select("z.c", "z.x")
    median = {r["c"]: r["q"][0] for r in exact_quantiles(long, ["c"], "x", [0.5]).collect()}  # a row a column
    filled = lambda df, c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(median.get(c, 0.0)))
    stats = train.agg(*[f(filled(train, c)).alias(f"{n}:{c}") for c in block for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if scale and block else {}

    def columns(df: DataFrame) -> DataFrame:
        for c in cols:
            x = filled(df, c)
            if scale and c in block:
                x = (x - F.lit(stats[f"m:{c}"])) / F.lit(stats[f"s:{c}"] or 1.0)
            df = df.withColumn(f"__f_{c}", x)
        a = VectorAssembler(inputCols=[f"__f_{c}" for c in block], outputCol="__block").transform(df) if block else df
        return a

    project, k = (None, len(block))
    if share is not None and block:
        project, k = pca_features(columns(train).select("__block"), "__block", share)

    def apply(df: DataFrame) -> DataFrame:
        out = columns(df)
        if project:
            out = project(out)
        parts = [F.array(*[F.col(f"__f_{c}") for c in plain]).cast("array<double>"), vector_to_array("__block") if block else F.array().cast("array<double>")]
        return out.withColumn("features", array_to_vector(F.concat(*parts))).drop("__block", *[f"__f_{c}" for c in cols])

    return apply, [*plain, *(pca_names(prefix, k) if share is not None else block)]


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Add weight = rows / (classes * rows of the class)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = n.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k"))
    # a row a class
    return df.join(F.broadcast(n.join(F.broadcast(total))), label).withColumn("weight", F.col("__all") / (F.col("__k") * F.col("__n"))).drop("__n", "__all", "__k")


def grid(family: str, rows: int, trees: int = TREES) -> dict[str, object]:
    """Unfitted models of a family ('rf' or 'svm') by name; C of an SVM is 1 / (regParam * rows)."""
    if family == "rf":
        return {
            f"rf_depth{d}_leaf{m}": RandomForestClassifier(numTrees=trees, maxDepth=d, minInstancesPerNode=m, featureSubsetStrategy="sqrt", weightCol="weight", seed=42) for d in (30, 10) for m in (1, 3)
        }
    return {f"svm_C{c:g}": LinearSVC(regParam=1.0 / (c * max(1, rows)), maxIter=100, weightCol="weight") for c in (0.1, 1.0, 10.0)}


def _score(model, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    raw = vector_to_array("rawPrediction")
    return out.withColumn("score", raw[1] - raw[0]).withColumn("prediction", F.col("prediction").cast("int"))


def cross_validate(df: DataFrame, label: str, fold: str, models: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold rows with config, prediction, score; metrics by config). ``df`` has
    features (vector), ``label`` (0 or 1) and ``fold``, in which groups lie whole."""
    df = class_weights(df, label).withColumn("label", F.col(label).cast("double")).cache()
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    rows = None
    for name, model in models.items():
        for k in folds:
            part = _score(model.fit(df.where(F.col(fold) != k)), df.where(F.col(fold) == k))
            part = part.select(F.lit(name).alias("config"), label, fold, "prediction", "score")
            rows = part if rows is None else rows.unionByName(part)
    rows = settle(rows, "oof")
    df.unpersist()
    return rows, binary_metrics(rows, ["config"], label, "prediction")


def platt(scores: DataFrame, label: str, score: str = "score"):
    """Model of a logistic curve fitted to out-of-fold scores; ``with_probability`` applies it."""
    x = scores.select(array_to_vector(F.array(F.col(score).cast("double"))).alias("features"), F.col(label).cast("double").alias("label"))
    n = max(1, x.count())
    return LogisticRegression(regParam=1.0 / n, standardization=False, maxIter=100).fit(x)


def with_probability(model, rows: DataFrame, score: str = "score") -> DataFrame:
    z = F.lit(float(model.intercept)) + F.lit(float(model.coefficients[0])) * F.col(score)
    return rows.withColumn("probability", 1 / (1 + F.exp(-z)))


def best_threshold(rows: DataFrame, label: str, probability: str = "probability"):
    """The smallest of the thresholds with the greatest macro-F1, and that value."""
    best = threshold_sweep(rows, label, probability).agg(F.max(F.struct(F.round("macro_f1", 9).alias("f"), (-F.col("threshold")).alias("t"))).alias("b")).first()["b"]
    return -best["t"], best["f"]


def select_and_refit(train: DataFrame, label: str, fold: str, family: str, trees: int = TREES) -> dict:
    """Best of a family's grid by macro-F1 of its out-of-fold predictions (ties: the first),
    fitted again to all of ``train``, with its calibration and threshold."""
    models = grid(family, train.count(), trees)
    oof, metrics = cross_validate(train, label, fold, models)
    score = {r["config"]: round(r["macro_f1"], 9) for r in metrics.collect()}
    name = max(models, key=lambda m: (score[m], -list(models).index(m)))
    curve = platt(oof.where(F.col("config") == name), label)
    at, f1 = best_threshold(with_probability(curve, oof.where(F.col("config") == name)), label)
    full = class_weights(train, label).withColumn("label", F.col(label).cast("double"))
    return {"name": name, "model": models[name].fit(full), "platt": curve, "threshold": at, "cv_macro_f1": score[name], "tuned_macro_f1": f1}


def predict(chosen: dict, df: DataFrame) -> DataFrame:
    """score, probability and the prediction at the tuned threshold."""
    out = with_probability(chosen["platt"], _score(chosen["model"], df))
    return out.withColumn("prediction", (F.col("probability") >= chosen["threshold"]).cast("int"))


def evaluate_settings(train: DataFrame, test: DataFrame, settings: dict[str, dict], label: str, fold: str, key: str, families: tuple[str, ...] = ("rf", "svm"), trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """(results: setting, family, config, threshold, cv_macro_f1, n, accuracy, macro_f1;
    predictions: setting, family, key, probability, prediction) of every setting with
    every family. A setting holds the arguments of prepare_blocks."""
    spark, results, rows = train.sparkSession, [], None
    for setting, blocks in settings.items():
        prepare, _ = prepare_blocks(train, **blocks)
        a, b = prepare(train), prepare(test)
        for family in families:
            chosen = select_and_refit(a, label, fold, family, trees)
            p = settle(predict(chosen, b).select(F.lit(setting).alias("setting"), F.lit(family).alias("family"), key, label, "probability", "prediction"), "predictions")
            m = binary_metrics(p, ["setting"], label, "prediction").first()
            results.append((setting, family, chosen["name"], float(chosen["threshold"]), float(chosen["cv_macro_f1"]), m["n"], m["accuracy"], m["macro_f1"]))
            rows = p if rows is None else rows.unionByName(p)
    schema = "setting string, family string, config string, threshold double, cv_macro_f1 double, n long, accuracy double, macro_f1 double"
    return spark.createDataFrame(results, schema), rows


def refit_best(results: DataFrame, every: DataFrame, new: DataFrame, settings: dict[str, dict], label: str, fold: str, key: str, trees: int = TREES) -> DataFrame:
    """The best setting of each family by test macro-F1 (an optimistic pick: it was chosen
    on the test rows), fitted again to ``every`` row and applied to ``new`` ones."""
    best = results.groupBy("family").agg(F.max(F.struct(F.round("macro_f1", 9).alias("f"), "setting")).alias("b")).select("family", "b.setting").collect()
    out = None
    for r in best:
        prepare, _ = prepare_blocks(every, **settings[r["setting"]])
        chosen = select_and_refit(prepare(every), label, fold, r["family"], trees)
        p = predict(chosen, prepare(new)).select(F.lit(r["family"]).alias("family"), F.lit(r["setting"]).alias("setting"), key, "probability", "prediction")
        out = p if out is None else out.unionByName(p)
    return out


def save_bundle(chosen: dict, columns: list[str], path: str) -> None:
    """Model, calibration and what is needed to apply them, under one folder."""
    spark = SparkSession.getActiveSession()
    PipelineModel([chosen["model"]]).write().overwrite().save(f"{path}/model")
    chosen["platt"].write().overwrite().save(f"{path}/platt")
    meta = {k: chosen[k] for k in ("name", "threshold", "cv_macro_f1")} | {"input_columns": columns}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_bundle(spark: SparkSession, path: str) -> dict:
    from pyspark.ml.classification import LogisticRegressionModel

    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return meta | {"model": PipelineModel.load(f"{path}/model"), "platt": LogisticRegressionModel.load(f"{path}/platt")}


def permutation_importance(model, df: DataFrame, names: list[str], label: str, key: str, repeats: int = 300, seed: int = 7) -> DataFrame:
    """feature, mean, std (population), se = std / sqrt(repeats) of the drop of macro-F1
    when a feature's values are dealt out anew: the row of rank i by ``key`` gets the
    value of the row of rank i by a hash of key and repeat. Ranks are taken in two
    levels, and all repeats of a feature are one pass."""
    base = binary_metrics(_score(model, df).withColumn("g", F.lit(1)), ["g"], label, "prediction").first()["macro_f1"]
    arr = settle(df.select(key, label, vector_to_array("features").alias("__a")).withColumn("__k", F.col(key).cast("string")), "rows")
    here = settle(ranked(arr, [], [F.md5("__k"), F.col("__k")], F.substring(F.md5("__k"), 1, 2), "__r"), "here")
    out = None
    for i, name in enumerate(names):
        draws = arr.select("__k", F.col("__a")[i].alias("__v"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
        h = F.md5(F.concat_ws(":", F.lit(seed), "repeat", "__k"))
        dealt = ranked(draws, ["repeat"], [h, F.col("__k")], F.substring(h, 1, 2), "__r").select("repeat", "__r", "__v")
        x = here.join(dealt, "__r").withColumn("features", array_to_vector(F.transform("__a", lambda v, k: F.when(k == F.lit(i), F.col("__v")).otherwise(v))))
        m = binary_metrics(_score(model, x), ["repeat"], label, "prediction").select((F.lit(base) - F.col("macro_f1")).alias("drop"))
        one = m.agg(F.lit(name).alias("feature"), F.avg("drop").alias("mean"), F.stddev_pop("drop").alias("std"), (F.stddev_pop("drop") / F.sqrt(F.count(F.lit(1)))).alias("se"))
        out = one if out is None else out.unionByName(one)
    return out

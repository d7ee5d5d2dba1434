"""Queries of evaluations and rank studies: metrics, rankings, scaling, work plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import metrics as M
from ..operators import ranking as R
from ..operators import scaling as Z
from ..sources import table

REPLICATES = 10_000


def _labelled(s: SparkSession, d: str) -> DataFrame:
    t, p = (F.col("l_returnflag") == "R").cast("int"), (F.col("l_discount") > 0.05).cast("int")
    return table(s, d, "lineitem").select(F.concat_ws("/", "l_linestatus", F.col("l_linenumber").cast("string")).alias("config"), t.alias("truth"), p.alias("pred"), (F.col("l_quantity") / 50).alias("score"))


def classification_metrics(s: SparkSession, d: str) -> DataFrame:
    m = M.binary_metrics(_labelled(s, d), ["config"], "truth", "pred")
    return m.select("config", "n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


def best_config_confusion(s: SparkSession, d: str) -> DataFrame:
    rows = _labelled(s, d)
    best = M.binary_metrics(rows, ["config"], "truth", "pred").select(F.max_by("config", F.struct(F.round("macro_f1", 9), "config")).alias("config"))
    return M.confusion(rows.join(F.broadcast(best), "config", "left_semi"), "truth", "pred").select("truth", "pred", "n", F.round("share", 6).alias("share"))


def threshold_sweep(s: SparkSession, d: str) -> DataFrame:
    return M.threshold_sweep(_labelled(s, d), "truth", "score").select("threshold", F.round("macro_f1", 6).alias("macro_f1"))


def crosstab(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").withColumn("p", F.substring("o_orderpriority", 1, 1))
    wide = o.groupBy("o_orderstatus").pivot("p", ["1", "2", "3", "4", "5"]).count().fillna(0)
    return wide.select("o_orderstatus", *[F.col(c).alias("p" + c) for c in "12345"])


def conditional_counts(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "document_units")
    return u.groupBy("unit_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").rlike("Sb")).alias("n_sb"), F.count_if("is_deleted").alias("n_deleted"))


def value_counts_reindex(s: SparkSession, d: str) -> DataFrame:
    dim = s.createDataFrame([(x,) for x in ("0D", "1D", "2D", "3D", "4D")], "label string")
    n = table(s, d, "compound_records").groupBy(F.col("sb_halide_dimensionality_llm").alias("label")).count()
    return dim.join(n, "label", "left").select("label", F.coalesce("count", F.lit(0).cast("long")).alias("n"))


def composition_share(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return n.select("c_mktsegment", "c_nationkey", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("c_mktsegment")), 6).alias("share"))


def fold_summary(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg((F.avg("l_discount") - F.avg("l_tax")).alias("x"))
    se = F.stddev_samp("x") / F.sqrt(F.count("x"))
    g = f.groupBy("l_returnflag").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.count("x").alias("n"), se.alias("se"), F.count_if(F.col("x") > 0).alias("n_positive"))
    return g.select("l_returnflag", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n", F.round("se", 6).alias("se"), "n_positive", F.round(F.col("mean") / F.nullif("se", F.lit(0.0)), 4).alias("z"))


def block_rollup(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").groupBy("p_type", "p_brand").agg(F.avg("p_retailprice").alias("v"))
    return p.groupBy("p_type").agg(F.round(F.sum("v"), 4).alias("sum"), F.round(F.avg("v"), 4).alias("mean"), F.count(F.lit(1)).alias("size"))


def _board(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.round(F.avg("l_extendedprice"), 4).alias("score"))


def best_per_family(s: SparkSession, d: str) -> DataFrame:
    b = _board(s, d).groupBy("l_returnflag").agg(F.min(F.struct((-F.col("score")).alias("s"), "l_linestatus", "l_linenumber")).alias("b"))
    return b.select("l_returnflag", "b.l_linestatus", "b.l_linenumber", (-F.col("b.s")).alias("score"))


def union_leaderboard(s: SparkSession, d: str) -> DataFrame:
    a = _board(s, d).select(F.concat_ws("/", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("config"), "score")
    b = table(s, d, "orders").groupBy(F.concat_ws("/", F.lit("order"), "o_orderpriority").alias("config")).agg(F.round(F.avg("o_totalprice"), 4).alias("score"), F.count(F.lit(1)).alias("n"))
    return a.unionByName(b, allowMissingColumns=True).orderBy(F.desc("score"), "config")


def condition_gain(s: SparkSession, d: str) -> DataFrame:
    w = _board(s, d).groupBy("l_linestatus", "l_linenumber").pivot("l_returnflag", ["A", "R"]).agg(F.first("score"))
    return w.select("l_linestatus", "l_linenumber", F.round(F.col("A") - F.col("R"), 4).alias("gain"))


def _ranks(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").groupBy((F.col("user_id") % 4).cast("int").alias("model"), F.col("user_id").alias("trial"), F.col("event_type").alias("feature")).agg(F.round(F.sum("value"), 6).alias("score"))
    return R.rank_items(e, ["model", "trial"], "feature", "score")


def borda_summary(s: SparkSession, d: str) -> DataFrame:
    g = _ranks(s, d).groupBy("model", "feature").agg(F.avg("borda").alias("mean_borda"), F.avg("rank").alias("mean_rank"), F.median("rank").alias("median_rank"), F.stddev_samp("rank").alias("rank_sd"), F.count(F.lit(1)).alias("n"))
    return g.select("model", "feature", *[F.round(c, 6).alias(c) for c in ("mean_borda", "mean_rank", "median_rank", "rank_sd")], "n")


def _final(s: SparkSession, d: str) -> DataFrame:
    m = _ranks(s, d).groupBy("model", "feature").agg(F.round(F.avg("borda"), 9).alias("mean_borda"))
    return R.average_ranks(m, ["model"], "mean_borda")


def average_rank(s: SparkSession, d: str) -> DataFrame:
    return _final(s, d).select("model", "feature", F.round("avg_rank", 3).alias("avg_rank"))


def kendall_pairwise(s: SparkSession, d: str) -> DataFrame:
    return R.pairwise_tau(R.ranking_classes(_ranks(s, d), "model", "trial", "feature"), "model").select("model", "ranking_a", "ranking_b", "n_pairs", F.round("tau", 6).alias("tau"))


def kendall_summary(s: SparkSession, d: str) -> DataFrame:
    p = R.pairwise_tau(R.ranking_classes(_ranks(s, d), "model", "trial", "feature"), "model")
    n = F.sum("n_pairs")
    mean = F.sum(F.col("tau") * F.col("n_pairs")) / n
    var = (F.sum(F.col("tau") * F.col("tau") * F.col("n_pairs")) - mean * mean * n) / (n - 1)
    g = p.groupBy("model").agg(mean.alias("mean_tau"), F.percentile("tau", F.lit(0.5), F.col("n_pairs")).alias("median_tau"), F.sqrt(var).alias("sd_tau"), F.min("tau").alias("min_tau"), F.max("tau").alias("max_tau"), n.alias("n_pairs"))
    return g.select("model", *[F.round(c, 6).alias(c) for c in ("mean_tau", "median_tau", "sd_tau", "min_tau", "max_tau")], "n_pairs")


def kendall_intermodel(s: SparkSession, d: str) -> DataFrame:
    return R.tau_b(_final(s, d), "model", "feature", "avg_rank").select(F.col("unit_a").alias("model_a"), F.col("unit_b").alias("model_b"), F.round("tau", 6).alias("tau"))


def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    b = R.bootstrap_mean(_ranks(s, d), ["model", "feature"], "trial", "borda", REPLICATES, "20260909")
    return b.select("model", "feature", F.round("mean", 6).alias("mean"), F.round("ci_lower", 6).alias("ci_lower"), F.round("ci_upper", 6).alias("ci_upper"))


def pivot_report(s: SparkSession, d: str) -> DataFrame:
    m = _final(s, d).select("feature", "model", F.format_string("%.3f", F.round("mean_borda", 6)).alias("v"))
    w = m.groupBy("feature").pivot("model", [0, 1, 2, 3]).agg(F.first("v"))
    return w.select("feature", *[F.col(str(i)).alias(f"model_{i}") for i in range(4)])


def validate_ranking(s: SparkSession, d: str) -> DataFrame:
    """Responses with a ranking that is a permutation of the features, and why others are not."""
    ranked = _ranks(s, d).groupBy("trial").agg(F.array_sort(F.collect_list(F.struct("rank", "feature"))).alias("x"))
    order = F.transform("x", lambda y: y["feature"])
    given = F.when(F.col("trial") % 5 == 1, F.slice(order, 1, 4)).when(F.col("trial") % 5 == 2, F.concat(F.slice(order, 1, 4), F.slice(order, 1, 1))).otherwise(order)
    text = F.when(F.col("trial") % 5 == 3, F.lit("not json")).when(F.col("trial") % 5 == 4, F.concat(F.lit('{"order":["'), F.array_join(given, '","'), F.lit('"]}'))).otherwise(F.concat(F.lit('{"ranking":["'), F.array_join(given, '","'), F.lit('"]}')))
    r = ranked.select("trial", text.alias("t"), F.array_sort(order).alias("want")).withColumn("keys", F.json_object_keys("t")).withColumn("got", F.from_json("t", "ranking array<string>")["ranking"])
    why = F.when(F.col("keys").isNull(), "no_object").when((F.size("keys") != 1) | (F.get("keys", F.lit(0)) != "ranking"), "keys").when(F.size("got") != F.size("want"), "length").when(F.array_sort("got") != F.col("want"), "items").otherwise("ok")
    return r.select("trial", why.alias("verdict"))


def paired_delta(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    mid = e.select(F.expr("timestamp_micros(cast((unix_micros(min(ts)) + unix_micros(max(ts))) / 2 as bigint))").alias("mid"))
    e = e.join(F.broadcast(mid)).withColumn("late", F.col("ts") >= F.col("mid"))
    side = lambda flag, name: e.where(F.col("late") == flag).groupBy("user_id", "event_type").agg(F.avg("value").alias(name))
    j = side(False, "before").join(side(True, "after"), ["user_id", "event_type"])
    return j.groupBy("event_type").agg(F.round(F.avg(F.col("after") - F.col("before")), 6).alias("delta"), F.count(F.lit(1)).alias("n"))


def paired_delta_ci(s: SparkSession, d: str) -> DataFrame:
    """Borda scores of the same trials before and after the middle of the time: both
    means, their difference and its bootstrap interval by model and feature."""
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    mid = e.select(F.expr("timestamp_micros(cast((unix_micros(min(ts)) + unix_micros(max(ts))) / 2 as bigint))").alias("mid"))
    e = e.join(F.broadcast(mid)).groupBy((F.col("ts") >= F.col("mid")).alias("late"), (F.col("user_id") % 4).cast("int").alias("model"), F.col("user_id").alias("trial"), F.col("event_type").alias("feature")).agg(F.round(F.sum("value"), 6).alias("score"))
    r = R.rank_items(e, ["late", "model", "trial"], "feature", "score")
    side = lambda flag, name: r.where(F.col("late") == flag).select("model", "trial", "feature", F.col("borda").alias(name))
    j = side(False, "before").join(side(True, "after"), ["model", "trial", "feature"]).withColumn("delta", F.col("after") - F.col("before"))
    means = j.groupBy("model", "feature").agg(F.avg("before").alias("before"), F.avg("after").alias("after"), F.count(F.lit(1)).alias("n"))
    out = R.bootstrap_mean(j, ["model", "feature"], "trial", "delta", REPLICATES, "20260909").withColumnRenamed("mean", "delta").join(means, ["model", "feature"])
    return out.select("model", "feature", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta", "ci_lower", "ci_upper")], "n")


def kendall_summary_ci(s: SparkSession, d: str) -> DataFrame:
    """Mean tau over pairs of trials of a model and its bootstrap interval over trials."""
    b = R.bootstrap_tau(R.ranking_classes(_ranks(s, d), "model", "trial", "feature"), "model", REPLICATES, 20260909)
    return b.select("model", *[F.round(c, 6).alias(c) for c in ("mean_tau", "ci_lower", "ci_upper")], "n_trials")


def _long(s: SparkSession, d: str) -> DataFrame:
    return Z.long_vectors(table(s, d, "embeddings"), "vec_id", "embedding")


def median_impute(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_tax") != 0.03, F.col("l_quantity")).alias("q"))
    return Z.impute_median(li, "q").groupBy("l_linenumber").agg(F.round(F.sum("q"), 4).alias("q"), F.count("q").alias("n"))


def standard_scale(s: SparkSession, d: str) -> DataFrame:
    return Z.standard_scale(_long(s, d)).select("vec_id", "dim", F.round("z", 6).alias("z"))


def robust_scale(s: SparkSession, d: str) -> DataFrame:
    return Z.robust_scale(_long(s, d)).select("vec_id", "dim", F.round("z", 6).alias("z"))


def drop_constant_columns(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(1).alias("one"), F.lit(None).cast("int").alias("none"))
    return p.select(*Z.varying_columns(p))


def embedding_collision_guard(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.transform("embedding", lambda x: x.cast("double"))).alias("n_vectors"), F.count_distinct("vec_id").alias("n_ids"))


def dense_topk(s: SparkSession, d: str) -> DataFrame:
    top = Z.cosine_top_k(table(s, d, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5)
    return top.select("query_id", "match_id", F.round("cosine", 5).alias("cosine"), "rank")


def linear_shap(s: SparkSession, d: str) -> DataFrame:
    """Mean absolute and mean contribution coef * (x - mean) of each feature of a linear model."""
    coef = {"l_quantity": 0.5, "l_discount": -2.0, "l_tax": 1.5}
    li = table(s, d, "lineitem")
    means = li.agg(*[F.avg(c).alias("m_" + c) for c in coef])
    x = li.join(F.broadcast(means)).agg(*[F.avg(F.abs(w * (F.col(c) - F.col("m_" + c)))).alias(c) for c, w in coef.items()])
    return x.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in coef]), F.array(*coef))).alias("feature", "v")).select("feature", F.round("v", 6).alias("mean_abs"))


def work_plan_remaining(s: SparkSession, d: str) -> DataFrame:
    plan = table(s, d, "nation").select("n_nationkey").join(F.broadcast(table(s, d, "region").select("r_regionkey"))).withColumn("mode", F.explode(F.array(F.lit("zero"), F.lit("all"))))
    done = table(s, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), (F.col("c_custkey") % 5).cast("int").alias("r_regionkey"), F.when(F.col("c_acctbal") > 5000, "zero").otherwise("all").alias("mode"))
    return M.remaining(plan, done, ["n_nationkey", "r_regionkey", "mode"])


def id_list_missing(s: SparkSession, d: str) -> DataFrame:
    want = s.createDataFrame([(f"P{i:04d}",) for i in range(1, 400)], "paper_id string")
    return want.join(table(s, d, "document_units").select(F.upper(F.trim("paper_id")).alias("paper_id")).distinct(), "paper_id", "left_anti")


def offset_limit(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20).select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


def mark_join(s: SparkSession, d: str) -> DataFrame:
    seen = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return table(s, d, "customer").join(seen, "c_custkey", "left").select("c_custkey", F.col("hit").isNotNull().alias("has_orders"))


def usage_cost(s: SparkSession, d: str) -> DataFrame:
    price = s.createDataFrame([("A", 10.0, 1.0, 50.0), ("R", 2.0, 0.5, 8.0)], "l_returnflag string, p_in double, p_cached double, p_out double")
    li = table(s, d, "lineitem").join(F.broadcast(price), "l_returnflag", "left")
    prompt, cached, out = F.col("l_quantity") * 100, F.col("l_quantity") * 40, F.col("l_linenumber") * 10
    cost = ((prompt - cached) * F.col("p_in") + cached * F.col("p_cached") + out * F.col("p_out")) / 1e6
    return li.groupBy("l_returnflag").agg(F.round(F.sum(cost), 6).alias("cost"), F.count(F.lit(1)).alias("calls"))


def conditional_prob(s: SparkSession, d: str) -> DataFrame:
    """Probability of the classes '0' and '1' given the log-probabilities of the tokens
    at the answer; the answer's own beside those of the alternatives."""
    tok = lambda t, p, when=None: F.struct(F.lit(t).alias("token"), p.alias("logprob")) if when is None else F.when(when, F.struct(F.lit(t).alias("token"), p.alias("logprob")))
    p1, p0 = -F.col("l_discount") * 10, -F.col("l_tax") * 20
    tokens = F.filter(F.array(tok("1", p1, F.col("l_linenumber") != 7), tok(" 1", p1 - 1.5), tok("0", p0, F.col("l_tax") > 0.01), tok("x", p0 - 3.0), tok("0 ", p0 - 2.0, F.col("l_linenumber") == 2)), lambda x: x.isNotNull())
    c = M.class_probability(tokens)
    li = table(s, d, "lineitem").select("l_linenumber", c.alias("c"))
    return li.groupBy("l_linenumber").agg(F.round(F.avg("c.p_one"), 6).alias("p"), F.sum(F.col("c.prediction").cast("long")).alias("n_one"), F.round(F.avg("c.mass"), 6).alias("mass"))


def condition_tau(s: SparkSession, d: str) -> DataFrame:
    """Kendall's tau of each model's final ranking before and after the middle of the time."""
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    mid = e.select(F.expr("timestamp_micros(cast((unix_micros(min(ts)) + unix_micros(max(ts))) / 2 as bigint))").alias("mid"))
    e = e.join(F.broadcast(mid)).groupBy((F.col("ts") >= F.col("mid")).cast("int").alias("late"), (F.col("user_id") % 4).cast("int").alias("model"), F.col("user_id").alias("trial"), F.col("event_type").alias("feature")).agg(F.round(F.sum("value"), 6).alias("score"))
    m = R.rank_items(e, ["late", "model", "trial"], "feature", "score").groupBy("late", "model", "feature").agg(F.round(F.avg("borda"), 9).alias("mean_borda"))
    r = R.average_ranks(m, ["late", "model"], "mean_borda").withColumn("unit", F.concat_ws(":", "model", "late"))
    t = R.tau_b(r, "unit", "feature", "avg_rank").where("substring_index(unit_a, ':', 1) = substring_index(unit_b, ':', 1)")
    return t.select(F.substring_index("unit_a", ":", 1).cast("int").alias("model"), F.round("tau", 6).alias("tau"))


def long_table_checks(s: SparkSession, d: str) -> DataFrame:
    """What is wrong with a long table of rankings, in one pass: keys that repeat, items
    that lack, scores that don't follow from ranks; one row a rule with its number of cases."""
    r = _ranks(s, d)
    # every fifth trial of model 2 lost a row, one of model 3 has a wrong score, one of model 1 comes twice
    r = r.where("not (model = 2 and trial % 5 = 0 and rank = 1)").withColumn("borda", F.when((F.col("model") == 3) & (F.col("trial") % 25 == 3), 0.9).otherwise(F.col("borda")))
    r = r.select("model", "trial", "feature", "rank", "k", "borda").unionByName(r.where("model = 1 and trial % 25 = 1").select("model", "trial", "feature", "rank", "k", "borda"))
    return R.check_rankings(r, "model", "trial", "feature", "rank", "k", "borda")


def valid_once(s: SparkSession, d: str) -> DataFrame:
    """Trials with other than one valid record under the expected hash: none, several, or
    several that disagree."""
    o = table(s, d, "orders").select((F.col("o_custkey") % 4).cast("int").alias("model"), (F.col("o_orderkey") % 500).alias("trial"), (F.col("o_totalprice") > 150000).alias("valid"), F.concat(F.lit("p"), F.col("o_orderkey") % 3).alias("protocol"), F.col("o_orderpriority").alias("ranking"))
    want = s.range(500).select(F.col("id").alias("trial")).join(F.broadcast(s.range(4).select(F.col("id").cast("int").alias("model"))))
    return R.select_valid(o, want, ["model", "trial"], F.col("valid") & (F.col("protocol") == "p1"), "ranking").where("verdict <> 'ok'")


def counterbalanced(s: SparkSession, d: str) -> DataFrame:
    """Order of the two conditions of each trial: odd ones begin without data."""
    t = table(s, d, "events").select(F.col("user_id").alias("trial")).distinct()
    odd = F.col("trial") % 2 == 1
    return t.select("trial", F.when(odd, "no_data").otherwise("with_data").alias("first"), F.when(odd, "with_data").otherwise("no_data").alias("second"))


def report_ci(s: SparkSession, d: str) -> DataFrame:
    """Mean score of each feature with its interval by model, side by side."""
    b = R.bootstrap_mean(_ranks(s, d), ["model", "feature"], "trial", "borda", REPLICATES, "20260909")
    b = b.select("model", "feature", F.format_string("%.3f [%.3f, %.3f]", "mean", "ci_lower", "ci_upper").alias("v"))
    w = b.groupBy("feature").pivot("model", [0, 1, 2, 3]).agg(F.first("v"))
    return w.select("feature", *[F.col(str(i)).alias(f"model_{i}") for i in range(4)])


QUERIES = {f.__name__: f for f in [classification_metrics, best_config_confusion, threshold_sweep, crosstab, conditional_counts, value_counts_reindex, composition_share, fold_summary, block_rollup, best_per_family, union_leaderboard, condition_gain, borda_summary, average_rank, kendall_pairwise, kendall_summary, kendall_intermodel, bootstrap_ci, pivot_report, validate_ranking, paired_delta, paired_delta_ci, kendall_summary_ci, median_impute, standard_scale, robust_scale, drop_constant_columns, embedding_collision_guard, dense_topk, linear_shap, work_plan_remaining, id_list_missing, offset_limit, mark_join, usage_cost, conditional_prob, condition_tau, long_table_checks, valid_once, counterbalanced, report_ci]}

_LAB = "l AS (SELECT l_linestatus || '/' || l_linenumber AS config, CAST(l_returnflag = 'R' AS INT) AS truth, CAST(l_discount > 0.05 AS INT) AS pred, l_quantity / 50 AS score FROM lineitem)"
_CNT = "c AS (SELECT config, count(*) AS n, sum(truth * pred) AS tp, sum((1 - truth) * pred) AS fp, sum(truth * (1 - pred)) AS fn, sum((1 - truth) * (1 - pred)) AS tn FROM l GROUP BY config), m AS (SELECT *, (CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END + CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END) / 2 AS f1 FROM c)"
_BOARD = "b AS (SELECT l_returnflag, l_linestatus, l_linenumber, round(avg(l_extendedprice), 4) AS score FROM lineitem GROUP BY ALL)"
_RANKS = """e AS (SELECT CAST(user_id % 4 AS INT) AS model, user_id AS trial, event_type AS feature, round(sum(value), 6) AS score FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY model, trial ORDER BY score DESC, feature) AS rank, count(*) OVER (PARTITION BY model, trial) AS k FROM e), rk AS (SELECT *, (k - rank) / nullif(k - 1, 0) AS borda FROM r)"""
_FINAL = f"{_RANKS}, m AS (SELECT model, feature, round(avg(borda), 9) AS mean_borda FROM rk GROUP BY ALL), fin AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY mean_borda DESC) + (count(*) OVER (PARTITION BY model, mean_borda) - 1) / 2.0 AS avg_rank FROM m)"
_PAIRS = f"""{_RANKS}, o AS (SELECT model, trial, string_agg(feature, '>' ORDER BY rank) AS rk FROM r GROUP BY ALL),
d AS (SELECT a.model, a.trial AS ta, b.trial AS tb, sum(sign(a.rank - a2.rank) * sign(b.rank - b2.rank)) / 2 AS s, any_value(a.k) AS k FROM r a JOIN r a2 ON a.model = a2.model AND a.trial = a2.trial JOIN r b ON b.model = a.model AND b.feature = a.feature AND a.trial < b.trial JOIN r b2 ON b2.model = b.model AND b2.trial = b.trial AND b2.feature = a2.feature GROUP BY 1, 2, 3),
pt AS (SELECT d.model, least(x.rk, y.rk) AS ranking_a, greatest(x.rk, y.rk) AS ranking_b, s / (k * (k - 1) / 2) AS tau FROM d JOIN o x ON x.model = d.model AND x.trial = ta JOIN o y ON y.model = d.model AND y.trial = tb)"""
_LONG = "v AS (SELECT vec_id, CAST(unnest(range(len(embedding))) AS INT) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"

SQL = {
    "classification_metrics": f"WITH {_LAB}, {_CNT} SELECT config, n, round((tp + tn) / n, 6) AS accuracy, round(f1, 6) AS macro_f1 FROM m",
    "best_config_confusion": f"WITH {_LAB}, {_CNT}, w AS (SELECT config FROM m ORDER BY round(f1, 9) DESC, config DESC LIMIT 1), g AS (SELECT unnest([0, 0, 1, 1]) AS truth, unnest([0, 1, 0, 1]) AS pred), x AS (SELECT truth, pred, count(*) AS n FROM l WHERE config = (SELECT config FROM w) GROUP BY ALL) SELECT truth, pred, coalesce(n, 0) AS n, round(coalesce(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY truth), 0), 0), 6) AS share FROM g LEFT JOIN x USING (truth, pred)",
    "threshold_sweep": f"WITH {_LAB}, t AS (SELECT round(0.05 + 0.9 * i / 180, 6) AS threshold FROM range(181) t(i)), h AS (SELECT score, sum(truth) AS pos, sum(1 - truth) AS neg FROM l GROUP BY score), c AS (SELECT threshold, sum(CASE WHEN score >= threshold THEN pos ELSE 0 END) AS tp, sum(CASE WHEN score >= threshold THEN neg ELSE 0 END) AS fp, sum(CASE WHEN score < threshold THEN pos ELSE 0 END) AS fn, sum(CASE WHEN score < threshold THEN neg ELSE 0 END) AS tn FROM t, h GROUP BY threshold) SELECT threshold, round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS macro_f1 FROM c",
    "crosstab": "SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (WHERE o_orderpriority LIKE '{i}%') AS p{i}" for i in range(1, 6)) + " FROM orders GROUP BY 1",
    "conditional_counts": "SELECT unit_type, count(*) AS n, count(*) FILTER (WHERE contains(text, 'Sb')) AS n_sb, count(*) FILTER (WHERE is_deleted) AS n_deleted FROM document_units GROUP BY 1",
    "value_counts_reindex": "SELECT label, count(sb_halide_dimensionality_llm) AS n FROM (SELECT unnest(['0D', '1D', '2D', '3D', '4D']) AS label) LEFT JOIN compound_records ON sb_halide_dimensionality_llm = label GROUP BY 1",
    "composition_share": "SELECT c_mktsegment, c_nationkey, round(count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment), 6) AS share FROM customer GROUP BY 1, 2",
    "fold_summary": "WITH f AS (SELECT l_returnflag, l_linenumber, avg(l_discount) - avg(l_tax) AS x FROM lineitem GROUP BY ALL), g AS (SELECT l_returnflag, avg(x) AS mean, stddev_samp(x) AS sd, count(x) AS n, stddev_samp(x) / sqrt(count(x)) AS se, count(*) FILTER (WHERE x > 0) AS n_positive FROM f GROUP BY 1) SELECT l_returnflag, round(mean, 6) AS mean, round(sd, 6) AS sd, n, round(se, 6) AS se, n_positive, round(mean / nullif(se, 0), 4) AS z FROM g",
    "block_rollup": "SELECT p_type, round(sum(v), 4) AS sum, round(avg(v), 4) AS mean, count(*) AS size FROM (SELECT p_type, p_brand, avg(p_retailprice) AS v FROM part GROUP BY ALL) GROUP BY 1",
    "best_per_family": f"WITH {_BOARD} SELECT l_returnflag, l_linestatus, l_linenumber, score FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY score DESC, l_linestatus, l_linenumber) AS r FROM b) WHERE r = 1",
    "union_leaderboard": f"WITH {_BOARD} SELECT l_returnflag || '/' || l_linestatus || '/' || l_linenumber AS config, score, CAST(NULL AS BIGINT) AS n FROM b UNION ALL SELECT 'order/' || o_orderpriority, round(avg(o_totalprice), 4), count(*) FROM orders GROUP BY 1",
    "condition_gain": f"WITH {_BOARD} SELECT l_linestatus, l_linenumber, round(max(CASE WHEN l_returnflag = 'A' THEN score END) - max(CASE WHEN l_returnflag = 'R' THEN score END), 4) AS gain FROM b GROUP BY 1, 2",
    "borda_summary": f"WITH {_RANKS} SELECT model, feature, round(avg(borda), 6) AS mean_borda, round(avg(rank), 6) AS mean_rank, round(median(rank), 6) AS median_rank, round(stddev_samp(rank), 6) AS rank_sd, count(*) AS n FROM rk GROUP BY 1, 2",
    "average_rank": f"WITH {_FINAL} SELECT model, feature, round(avg_rank, 3) AS avg_rank FROM fin",
    "kendall_pairwise": f"WITH {_PAIRS} SELECT model, ranking_a, ranking_b, count(*) AS n_pairs, round(any_value(tau), 6) AS tau FROM pt GROUP BY 1, 2, 3",
    "kendall_summary": f"WITH {_PAIRS} SELECT model, round(avg(tau), 6) AS mean_tau, round(median(tau), 6) AS median_tau, round(stddev_samp(tau), 6) AS sd_tau, round(min(tau), 6) AS min_tau, round(max(tau), 6) AS max_tau, count(*) AS n_pairs FROM pt GROUP BY 1",
    "kendall_intermodel": f"WITH {_FINAL}, p AS (SELECT a.model, a.feature AS i, b.feature AS j, sign(a.avg_rank - b.avg_rank) AS s FROM fin a JOIN fin b ON a.model = b.model AND a.feature < b.feature) SELECT x.model AS model_a, y.model AS model_b, round(sum(x.s * y.s) / sqrt(nullif(sum(abs(x.s)) * sum(abs(y.s)), 0)), 6) AS tau FROM p x JOIN p y ON x.i = y.i AND x.j = y.j AND x.model < y.model GROUP BY 1, 2",
    "bootstrap_ci": f"""WITH {_RANKS}, v AS (SELECT model, feature, borda, row_number() OVER (PARTITION BY model, feature ORDER BY trial) - 1 AS idx, count(*) OVER (PARTITION BY model, feature) AS n FROM rk),
      g AS (SELECT model, feature, any_value(n) AS n, avg(borda) AS mean FROM v GROUP BY ALL), dr AS (SELECT model, feature, n, r, i FROM g, range(1, {REPLICATES + 1}) t(r), range(1, 100000) u(i) WHERE i <= n),
      x AS (SELECT model, feature, r, CAST(('0x' || substr(md5('20260909:' || model || ':' || feature || ':' || r || ':' || i), 1, 8)) AS BIGINT) % n AS idx FROM dr),
      m AS (SELECT x.model, x.feature, r, avg(borda) AS m FROM x JOIN v ON v.model = x.model AND v.feature = x.feature AND v.idx = x.idx GROUP BY ALL)
      SELECT model, feature, round(any_value(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS ci_lower, round(quantile_cont(m, 0.975), 6) AS ci_upper FROM m JOIN g USING (model, feature) GROUP BY 1, 2""",
    "pivot_report": f"WITH {_FINAL} SELECT feature, " + ", ".join(f"max(CASE WHEN model = {i} THEN printf('%.3f', round(mean_borda, 6)) END) AS model_{i}" for i in range(4)) + " FROM fin GROUP BY 1",
    "validate_ranking": "SELECT DISTINCT user_id AS trial, CASE user_id % 5 WHEN 1 THEN 'length' WHEN 2 THEN 'items' WHEN 3 THEN 'no_object' WHEN 4 THEN 'keys' ELSE 'ok' END AS verdict FROM events",
    "paired_delta": "WITH mid AS (SELECT make_timestamp(CAST(floor((epoch_us(min(ts)) + epoch_us(max(ts))) / 2) AS BIGINT)) AS m FROM events), p AS (SELECT user_id, event_type, avg(value) FILTER (WHERE ts < m) AS b, avg(value) FILTER (WHERE ts >= m) AS a FROM events, mid GROUP BY 1, 2) SELECT event_type, round(avg(a - b), 6) AS delta, count(*) AS n FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1",
    "median_impute": "WITH x AS (SELECT l_linenumber, CASE WHEN l_tax <> 0.03 THEN l_quantity END AS q FROM lineitem) SELECT l_linenumber, round(sum(coalesce(q, (SELECT median(q) FROM x))), 4) AS q, count(*) AS n FROM x GROUP BY 1",
    "standard_scale": f"WITH {_LONG}, s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM v GROUP BY dim) SELECT vec_id, dim, round((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS z FROM v JOIN s USING (dim)",
    "robust_scale": f"WITH {_LONG}, s AS (SELECT dim, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) AS b FROM v GROUP BY dim) SELECT vec_id, dim, round((x - m) / CASE WHEN b = a THEN 1 ELSE b - a END, 6) AS z FROM v JOIN s USING (dim)",
    "drop_constant_columns": "SELECT p_partkey, p_size, p_retailprice FROM part",
    "embedding_collision_guard": "SELECT count(*) AS n, count(DISTINCT embedding) AS n_vectors, count(DISTINCT vec_id) AS n_ids FROM embeddings",
    "dense_topk": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS match_id, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT query_id, match_id, round(c, 5) AS cosine, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, match_id) AS r FROM p) WHERE r <= 5",
    "linear_shap": "WITH m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem) SELECT 'l_quantity' AS feature, round(avg(abs(0.5 * (l_quantity - q))), 6) AS mean_abs FROM lineitem, m UNION ALL SELECT 'l_discount', round(avg(abs(-2.0 * (l_discount - d))), 6) FROM lineitem, m UNION ALL SELECT 'l_tax', round(avg(abs(1.5 * (l_tax - t))), 6) FROM lineitem, m",
    "work_plan_remaining": "SELECT n_nationkey, r_regionkey, mode FROM nation, region, (SELECT unnest(['zero', 'all']) AS mode) EXCEPT SELECT c_nationkey, CAST(c_custkey % 5 AS INT), CASE WHEN c_acctbal > 5000 THEN 'zero' ELSE 'all' END FROM customer",
    "id_list_missing": "SELECT printf('P%04d', i) AS paper_id FROM range(1, 400) t(i) WHERE printf('P%04d', i) NOT IN (SELECT upper(trim(paper_id)) FROM document_units)",
    "offset_limit": "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10",
    "mark_join": "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders FROM customer",
    "usage_cost": "WITH p AS (SELECT * FROM (VALUES ('A', 10.0, 1.0, 50.0), ('R', 2.0, 0.5, 8.0)) t(l_returnflag, i, c, o)) SELECT l_returnflag, round(sum(((l_quantity * 60) * i + l_quantity * 40 * c + l_linenumber * 10 * o) / 1e6), 6) AS cost, count(*) AS calls FROM lineitem LEFT JOIN p USING (l_returnflag) GROUP BY 1",
    "conditional_prob": """WITH x AS (SELECT l_linenumber, -l_discount * 10 AS a, -l_tax * 20 AS z, l_tax > 0.01 AS has0, l_linenumber <> 7 AS has1, l_linenumber = 2 AS has02 FROM lineitem),
      y AS (SELECT l_linenumber, CASE WHEN has1 THEN exp(a) ELSE 0 END + exp(a - 1.5) AS r1, CASE WHEN has0 OR has02 THEN CASE WHEN has0 THEN exp(z) ELSE 0 END + CASE WHEN has02 THEN exp(z - 2) ELSE 0 END ELSE exp(least(CASE WHEN has1 THEN a ELSE 0 END, a - 1.5, z - 3)) END AS r0 FROM x)
      SELECT l_linenumber, round(avg(r1 / (r0 + r1)), 6) AS p, sum(CASE WHEN r1 >= r0 THEN 1 ELSE 0 END) AS n_one, round(avg(r0 + r1), 6) AS mass FROM y GROUP BY 1""",
    "condition_tau": """WITH mid AS (SELECT make_timestamp(CAST(floor((epoch_us(min(ts)) + epoch_us(max(ts))) / 2) AS BIGINT)) AS m FROM events),
      e AS (SELECT CAST(ts >= m AS INT) AS late, CAST(user_id % 4 AS INT) AS model, user_id AS trial, event_type AS feature, round(sum(value), 6) AS score FROM events, mid GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY late, model, trial ORDER BY score DESC, feature) AS rank, count(*) OVER (PARTITION BY late, model, trial) AS k FROM e),
      m AS (SELECT late, model, feature, round(avg((k - rank) / nullif(k - 1, 0)), 9) AS b FROM r GROUP BY ALL), f AS (SELECT *, rank() OVER (PARTITION BY late, model ORDER BY b DESC) + (count(*) OVER (PARTITION BY late, model, b) - 1) / 2.0 AS a FROM m),
      p AS (SELECT x.late, x.model, x.feature AS i, y.feature AS j, sign(x.a - y.a) AS s FROM f x JOIN f y ON x.late = y.late AND x.model = y.model AND x.feature < y.feature)
      SELECT x.model, round(sum(x.s * y.s) / sqrt(nullif(sum(abs(x.s)) * sum(abs(y.s)), 0)), 6) AS tau FROM p x JOIN p y ON x.model = y.model AND x.i = y.i AND x.j = y.j AND x.late = 0 AND y.late = 1 GROUP BY 1""",
    "long_table_checks": f"""WITH {_RANKS}, q AS (SELECT model, trial, feature, rank, k, CASE WHEN model = 3 AND trial % 25 = 3 THEN 0.9 ELSE borda END AS borda FROM rk WHERE NOT (model = 2 AND trial % 5 = 0 AND rank = 1)),
      t AS (SELECT * FROM q UNION ALL SELECT * FROM q WHERE model = 1 AND trial % 25 = 1), g AS (SELECT model, trial, count(*) AS n, count(DISTINCT feature) AS d, max(k) AS k FROM t GROUP BY 1, 2)
      SELECT 'repeated_key' AS rule, (SELECT count(*) FROM (SELECT 1 FROM t GROUP BY model, trial, feature HAVING count(*) > 1)) AS n UNION ALL SELECT 'missing_item', (SELECT count(*) FROM g WHERE d <> k) UNION ALL SELECT 'score', (SELECT count(*) FROM t WHERE abs(borda - (k - rank) / (k - 1)) > 1e-8)""",
    "valid_once": """WITH o AS (SELECT CAST(o_custkey % 4 AS INT) AS model, o_orderkey % 500 AS trial, o_orderpriority AS ranking FROM orders WHERE o_totalprice > 150000 AND o_orderkey % 3 = 1),
      w AS (SELECT CAST(m AS INT) AS model, t AS trial FROM range(4) a(m), range(500) b(t)), g AS (SELECT w.model, w.trial, count(ranking) AS n, count(DISTINCT ranking) AS d FROM w LEFT JOIN o ON o.model = w.model AND o.trial = w.trial GROUP BY 1, 2)
      SELECT model, trial, n, CASE WHEN n = 0 THEN 'missing' WHEN d > 1 THEN 'conflicting' ELSE 'repeated' END AS verdict FROM g WHERE n <> 1""",
    "counterbalanced": "SELECT DISTINCT user_id AS trial, CASE WHEN user_id % 2 = 1 THEN 'no_data' ELSE 'with_data' END AS first, CASE WHEN user_id % 2 = 1 THEN 'with_data' ELSE 'no_data' END AS second FROM events",
}

import json
from datetime import datetime

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.operators import calls, models
from lodestack.sources import load_config, load_env, read_csv_table, read_jsonl, read_jsonl_strict, write_csv_table
from lodestack.streaming.ledger import OrphanStream, intake


def test_ledger_calls_each_prompt_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id long, prompt string")
    ledger = str(tmp_path / "ledger")
    for _ in range(2):
        got = {r["id"]: r["response"] for r in calls.call_all(rows, "prompt", calls.stub("verify"), ledger).collect()}
    assert got == {1: calls.STUBS["verify"], 2: calls.STUBS["verify"], 3: calls.STUBS["verify"], 4: None}
    assert calls.read_ledger(spark, ledger).count() == 2

    def fails(prompt):
        raise ValueError("no")

    bad = calls.call_all(rows.where("id = 1"), "prompt", fails, str(tmp_path / "other")).first()
    assert bad["response"] is None and bad["error"] == "ValueError: no"


def test_repair_loop_is_bounded(spark):
    rows = spark.createDataFrame([(1, "0D", 0), (2, "1D", 1), (3, "2D", 9)], "id long, label string, need int")
    verify = lambda d: d.withColumn("status", F.when(F.col("cycle") >= F.col("need"), "supported").otherwise("uncertain"))
    got = {r["id"]: (r["label"], r["cycle"]) for r in calls.repair_loop(rows, verify, lambda d: d.drop("cycle")).collect()}
    assert got == {1: ("0D", 0), 2: ("1D", 1), 3: ("Unknown", 2)}


def test_repair_loop_fetches_evidence_again(spark):
    units = spark.createDataFrame([("P1", f"u{i}", f"the cation salt number {i}" if i % 3 else "halide layers with bridging contacts") for i in range(30)], "corpus string, doc string, text string")
    rows = spark.createDataFrame([(1, "P1", "1D", {"connectivity": ["u0"]}), (2, "P1", "2D", {"cation": []}), (3, "P1", "3D", {})], "id long, paper_id string, label string, sources map<string,array<string>>")

    def verify(d):
        enough = F.size(F.coalesce(F.try_element_at("sources", F.lit("connectivity")), F.array().cast("array<string>"))) > 5
        return d.select(
            "*",
            F.when((F.col("id") == 1) & enough, "supported").otherwise("incomplete_or_conflicting").alias("status"),
            F.array(F.lit("row_sanity"), F.lit("dimensionality_label"), F.lit("connectivity_evidence")).alias("failed_fields"),
            F.when(F.col("id") < 3, F.create_map(F.lit("connectivity_evidence"), F.lit("bridging halide"))).otherwise(F.create_map().cast("map<string,string>")).alias("recovery"),
            F.lit("weak").alias("notes"),
        )

    got = {r["id"]: r for r in calls.repair_loop(rows, verify, lambda d: d, units).collect()}
    assert {k: (r["label"], r["cycle"], r["review_reason"]) for k, r in got.items()} == {1: ("1D", 1, None), 2: ("Unknown", 2, "unresolved after verification: weak"), 3: ("Unknown", 0, "unresolved after verification: weak")}
    assert got[1]["sources"]["connectivity"] == ["u0", "u12", "u15", "u18", "u21", "u24", "u27", "u3", "u6", "u9"] and got[3]["sources"] == {}


def test_answers_are_checked(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id long, prompt string")
    bad = calls.call_all(rows, "prompt", lambda p: '{"x": 1}', str(tmp_path / "l"), required=("overall_status",), attempts=2).first()
    assert bad["response"] is None and "lacks overall_status" in bad["error"]


def test_models(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "grid", lambda family, rows, trees: {"svm_C1": models.LinearSVC(regParam=1 / rows, maxIter=10, weightCol="weight")})
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 4))
    y = (x[:, 0] + 0.1 * rng.normal(size=120) > 0).astype(int)
    rows = [(i, *[float(v) if (i + j) % 17 else None for j, v in enumerate(x[i])], int(y[i]), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int, fold int")
    setting = {"plain": ["a"], "block": ["b", "c", "d"], "prefix": "z", "scale": True, "share": 0.8}
    prepare, names = models.prepare_blocks(df, **setting)
    assert names[0] == "a" and names[1:] == [f"z_PC{i}" for i in range(1, len(names))] and len(prepare(df).first()["features"]) == len(names)
    ready = prepare(df).select("id", "y", "fold", "features")
    chosen = models.select_and_refit(ready, "y", "fold", "svm")
    assert chosen["cv_macro_f1"] > 0.85 and 0.05 <= chosen["threshold"] <= 0.95
    models.save_bundle(chosen, names, str(tmp_path / "bundle"))
    again = models.load_bundle(spark, str(tmp_path / "bundle"))
    a, b = ({r["id"]: r["prediction"] for r in models.predict(c, ready).collect()} for c in (chosen, again))
    assert a == b and again["input_columns"] == names
    imp = {r["feature"]: r["mean"] for r in models.permutation_importance(chosen["model"], ready, names[:2], "y", "id", repeats=2).collect()}
    assert imp["a"] > imp[names[1]]
    # a share of all variance: 80 equal dimensions and one large need more than the first components alone
    wide = np.random.default_rng(1).normal(size=(300, 12)) * np.r_[3.0, np.ones(11)]
    wide_df = spark.createDataFrame([(r.tolist(),) for r in wide], "v array<double>").select(array_to_vector("v").alias("features"))
    centred = wide - wide.mean(0)
    cum = np.cumsum(np.linalg.svd(centred, compute_uv=False) ** 2)
    _, k = models.pca_features(wide_df, "features", 0.8)
    assert k == int(np.searchsorted(cum / cum[-1], 0.8, side="right") + 1)


def test_files(spark, tmp_path):
    schema = T.StructType.fromDDL("k string, n int")
    assert read_jsonl(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "a.jsonl").write_text('{"k": "x", "n": 1}\n\n{bad\n{"k": null}\n')
    assert read_jsonl(spark, str(tmp_path / "a.jsonl"), schema).where("k = 'x'").count() == 1
    try:
        read_jsonl_strict(spark, str(tmp_path / "a.jsonl"), schema).collect()
        raise AssertionError("a malformed line passed")
    except Exception as e:
        assert "MALFORMED" in str(e).upper() or "FAILED_READ" in str(e).upper()
    (tmp_path / "c.csv").write_text("k,n\nx,2\n")
    assert read_csv_table(spark, str(tmp_path / "c.csv"), schema).first()["n"] == 2
    write_csv_table(read_csv_table(spark, str(tmp_path / "c.csv"), schema), str(tmp_path / "again"))
    assert read_csv_table(spark, str(tmp_path / "again"), schema).first()["n"] == 2
    (tmp_path / "c.json").write_text('{"paths": {"data": "x", "root": "/y"}}')
    assert load_config(str(tmp_path / "c.json"))["paths"] == {"data": str(tmp_path / "x"), "root": "/y"}
    (tmp_path / "env").write_text("# no\nA=1\n\nB='two'\nC = 3\n")
    assert load_env(str(tmp_path / "env"), {"A": "0"}) == {"A": "0", "B": "two", "C": "3"}


def test_streams(spark, tmp_path):
    src, sink = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    schema = T.StructType.fromDDL("k string, n int")
    for i in range(2):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"k": k, "n": i}) for k in ("a", "b", f"c{i}")))
        intake(spark, str(src), schema, "k", sink, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(sink).collect()) == ["a", "b", "c0", "c1"]
    seen = []
    stream = OrphanStream(spark, str(tmp_path / "state"), lambda d: seen.append(sum(r["n"] for r in d.collect())), parts=4)
    at = datetime(2024, 1, 1)
    cols = "kind string, key string, id long, at timestamp, deleted boolean"
    stream.take(spark.createDataFrame([("reference", "p", 1, at, None)], cols), 0)
    stream.take(spark.createDataFrame([("parent", "P", 1, at, False)], cols), 1)
    stream.take(spark.createDataFrame([("parent", "p", 2, datetime(2024, 2, 1), True)], cols), 2)
    assert seen == [1, 0, 1]

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.functions import chem, text
from lodestack.operators import assembly, metrics, retrieval, scaling, selection
from lodestack.operators.skew import ranked


def test_document_is_one_json_array(spark, tmp_path):
    for rows in ([(i, f"n{i % 3}", None) for i in range(40)], [(1, "same", None)] * 3, []):
        df = spark.createDataFrame(rows, "i long, name string, none string").repartition(5)
        assembly.write_document(df, str(tmp_path / "doc"), ["name", "i"])
        parts = sorted((tmp_path / "doc").glob("part-*"))
        got = json.loads("".join(p.read_text() for p in parts))
        assert got == [{"i": i, "name": n, "none": None} for i, n, _ in sorted(rows, key=lambda r: (r[1], r[0]))]


def test_final_table_tolerates_missing_columns(spark):
    df = spark.createDataFrame([("P1", "P1_C1", "0D", ["Cl", None, "Br"])], "paper_id string, compound_id string, sb_halide_dimensionality_llm string, halides_present array<string>")
    r = assembly.final_table(df).first()
    assert len(r) == 29 and r["sb_halide_dimensionality"] == "0D" and r["halides_present"] == "Cl; Br" and r["verification_notes"] is None


def test_required_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, smi_0 int")
    assert assembly.columns_with_prefix(df, "smi_") == ["smi_0"] and assembly.require_columns(df, ["a"]) is df
    with pytest.raises(ValueError, match="missing columns: b, c"):
        assembly.require_columns(df, ["c", "a", "b"])
    with pytest.raises(ValueError, match="more than once"):
        assembly.one_to_one(df, df.union(df), ["a"])


# Inputs and what must come out.
def test_flags(spark):
    rows = [("[Et2O\u25ca\u25ca\u25caH]", None, None, None, None), ("x [?]-I", "[SbCl2(L)]", ["ok", "\u25ca"], None, ["Br"]), (None, None, None, None, None), ("\u2192 \u2261 \u2070", "SbI3", [], "", ["I", None])]
    df = spark.createDataFrame(rows, "name string, formula string, cations array<string>, unit string, bonded array<string>")
    got = [r[0] for r in df.select(assembly.automatic_flags(*[F.col(c) for c in df.columns])).collect()]
    assert got[0] == ["compound_name_reported: unexpected character(s) U+25CA '\u25ca'"] and got[2] == [] and got[3] == []
    assert got[1][0].startswith("compound_name_reported: contains '[?]'") and got[1][1].startswith("cation_formula_explicit[1]: unexpected")
    assert got[1][2:] == ["halide(s) ['Cl'] appear in compound_formula_reported ('[SbCl2(L)]') but are not listed in halides_bonded_to_sb", "halides_bonded_to_sb lists ['Br'], not found in compound_formula_reported ('[SbCl2(L)]')"]


def test_assembled_records_have_defaults(spark):
    comp = spark.createDataFrame([("P1", "c1", [], None, "f", "t1", 1), ("P1", "c1", ["1", "1a"], "", "f", "t2", 2), ("P1", None, None, None, None, "t", 3)], "paper_id string, compound_id string, labels_in_paper array<string>, compound_name_reported string, compound_formula_reported string, created_at string, registry_row_id long")
    names = "cation_name_reported array<string>, cation_abbreviation_reported array<string>, cation_formula_explicit array<string>, cation_formula_status array<string>"
    cat = spark.createDataFrame([], f"compound_id string, {names}, cation_evidence_text string, cation_source array<string>, created_at string, cation_row_id long")
    dim = spark.createDataFrame([("c1", "1D", "conflicting", "t", 1)], "compound_id string, sb_halide_dimensionality_llm string, dimensionality_evidence_status string, created_at string, dim_row_id long")
    for c, t in [("sb_oxidation_state_reported", "string"), ("halides_present", "array<string>"), ("halides_bonded_to_sb", "array<string>"), ("sb_halide_unit_reported", "string"), ("sb_halide_connectivity_evidence_text", "string"), ("connectivity_source", "array<string>"), ("dimensionality_reasoning", "string"), ("dimensionality_review_reason", "string")]:
        dim = dim.withColumn(c, F.lit(None).cast(t))
    dossiers = spark.createDataFrame([("c1", "synthesis", "old", ["a"], 1), ("c1", "synthesis", "new", ["b"], 2)], "compound_id string, category string, evidence_text string, source_ids array<string>, n int")
    r = assembly.assemble_records(comp, cat, dim, dossiers).collect()
    assert len(r) == 1 and len(r[0]) == 25
    r = r[0]
    assert (r["label_in_paper"], r["sb_halide_dimensionality_llm"], r["cation_formula_status"], r["cation_evidence_text"], r["synthesis_evidence_text"], r["synthesis_source"], r["synthesis_target_compound"]) == ("1, 1a", "Unknown", [], "", "new", ["b"], "c1")


def test_exact_quantiles(spark):
    rng = random.Random(1)
    rows = [(g, v) for g in "abc" for v in [rng.choice([rng.gauss(0, 1), 1e9 * rng.random(), 5.0, None, float("nan")]) for _ in range(300)]] + [("d", None), ("e", 7.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["q"] for r in scaling.exact_quantiles(df, ["g"], "x", [0.0, 0.25, 0.5, 0.975, 1.0]).collect()}
    for g in "abce":
        v = [x for k, x in rows if k == g and x is not None and x == x]
        assert np.allclose(got[g], np.quantile(v, [0, 0.25, 0.5, 0.975, 1]))
    assert "d" not in got


def test_ranks_in_two_levels(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", None]), rng.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, a int, i int")
    got = {(r["g"], r["i"]): r["n"] for r in ranked(df, ["g"], ["a", "i"], F.floor(F.col("a") / 10), "n").collect()}
    for g in ("x", "y", None):
        assert [got[g, i] for _, i in sorted((a, i) for k, a, i in rows if k == g)] == list(range(1, sum(k == g for k, _, _ in rows) + 1))


def test_folds_and_holdout(spark):
    rng = random.Random(3)
    rows = [(f"g{g}", int(rng.random() < 0.3)) for g in range(60) for _ in range(rng.choice([1, 2, 5, 20]))]
    df = spark.createDataFrame(rows, "g string, y int")
    fold = {r["g"]: r["fold"] for r in selection.stratified_folds(df, "g", "y", 5).collect()}
    assert len(fold) == 60
    size = [sum(fold[g] == f for g, _ in rows) for f in range(5)]
    ones = [sum(y for g, y in rows if fold[g] == f) for f in range(5)]
    assert max(size) - min(size) <= 12 and max(ones) - min(ones) <= 8
    held = {r["g"]: r["held"] for r in selection.grouped_holdout(df, "g", "y", tries=300).collect()}
    share = sum(held[g] for g, _ in rows) / len(rows)
    assert abs(share - 0.2) < 0.03 and abs(np.mean([y for g, y in rows if held[g]]) - np.mean([y for _, y in rows])) < 0.05
    with pytest.raises(ValueError):
        selection.grouped_holdout(df.withColumn("y", F.lit(1)), "g", "y", tries=5)


def test_aliases_by_join_are_those_of_the_automaton(spark):
    rows = [(1, "Square Pyramids and chains"), (2, None), (3, ""), (4, "chainsaw"), (5, "ab")]
    df = spark.createDataFrame(rows, "id long, text string")
    names = ["CHAINS", "square pyramids", "ab", "a", "", "zz"]
    a = sorted(tuple(r) for r in retrieval.alias_hits(df, ["id"], "text", names).collect())
    b = sorted(tuple(r) for r in retrieval.alias_hits(df, ["id"], "text", spark.createDataFrame([(n,) for n in names], "alias string")).collect())
    assert a == b == [(1, "chains"), (1, "square pyramids"), (4, "chains"), (5, "ab")]


def test_class_probability(spark):
    cases = [([("0", -0.1), (" 1", -3.0)], 0, None), ([("1", -1.0), ("x", -2.0)], 1, None), ([("x", -1.0)], None, "no class token"), ([("0", -1.0), ("1", -1.0)], 1, None)]
    df = spark.createDataFrame([(i, [{"token": t, "logprob": p} for t, p in c[0]]) for i, c in enumerate(cases)], "i int, t array<struct<token:string,logprob:double>>")
    got = [(r["c"]["prediction"], r["c"]["error"]) for r in df.select("i", metrics.class_probability(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [(p, e) for _, p, e in cases]


def test_small_functions(spark):
    one = spark.createDataFrame([("  12.50 ", ["a ", None, "c"], 0.25, 3.0)], "s string, row array<string>, x double, y double")
    r = one.select(text.joined_row(F.col("row")), text.joined_labels(F.array().cast("array<string>")), text.shortest_number(F.col("x")), text.shortest_number(F.col("y")), text.signed(F.lit("3")), text.signed(F.lit("+3")), text.before_last(F.lit("a|b|c"), "|"), text.canonical_json({"b": F.lit("x]"), "a": F.lit(None).cast("string")})).first()
    assert list(r) == ["a |  | c", None, "0.25", "3", "+3", "+3", "a|b", '{"a":null,"b":"x]"}']
    f = spark.createDataFrame([("C(=O)[O-].[NH4+]",), ("C(",), ("",)], "s string").select(chem.atom_counts(F.col("s"))).collect()
    assert [{x["element"]: x["count"] for x in r[0]} if r[0] else None for r in f] == [{"C": 1.0, "N": 1.0, "O": 2.0}, None, None]

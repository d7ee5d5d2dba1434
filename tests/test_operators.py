"""Golden vectors and brute-force versions of core operators."""

import random

from pyspark.sql import functions as F

from lodestack.functions import chem as C
from lodestack.functions import text as X
from lodestack.operators.graph import connected_components
from lodestack.operators.metrics import keep_last, threshold_sweep
from lodestack.operators.reading import forward_fill
from lodestack.operators.retrieval import bm25_terms, shingle_pairs
from lodestack.operators.scaling import varying_columns


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_control_characters(spark):
    assert one(spark, X.repaired_controls, "[SbCl2(L)]\x7f(0.5thf)\x7f(0.5Et2O)") == "[SbCl2(L)]·(0.5thf)·(0.5Et2O)"
    assert one(spark, X.repaired_controls, "[{SbI(L)(\x03bc-I)}2]") == "[{SbI(L)(μ-I)}2]"
    assert one(spark, X.repaired_controls, "[{SbI(L)(\x03-I)}2]") == "[{SbI(L)([?]-I)}2]"
    assert one(spark, X.odd_characters, "[Et2O◊◊◊H(L)H◊◊◊OEt2]") == ["◊"]


def test_formula(spark):
    get = lambda s: one(spark, C.formula_counts, s)
    assert [(p["element"], p["count"]) for p in get("[Sb2Cl9](C2H8N)")] == [("Sb", 2.0), ("Cl", 9.0), ("C", 2.0), ("H", 8.0), ("N", 1.0)]
    for bad in ("SbClx", "Sb3+2-", "α-SbCl3", "", "SbCl3·H2O"):
        assert get(bad) is None


def test_components_brute_force(spark):
    rng = random.Random(1)
    rows = [(f"m{rng.randrange(60)}", f"k{rng.randrange(50)}") for _ in range(70)] + [("lone", None), ("m1", None), (None, "k1")]
    rows += [(f"chain{i}", f"c{i + j}") for i in range(40) for j in (0, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for m, k in rows:
        if m and k:
            parent[find(m)] = find("k:" + k)
    groups = {}
    for m in {m for m, _ in rows if m}:
        groups.setdefault(find(m), []).append(m)
    want = {m: min(g) for g in groups.values() for m in g}
    got = connected_components(spark.createDataFrame(rows, "m string, k string"), "m", "k").collect()
    assert {r["m"]: r["component"] for r in got} == want
    assert connected_components(spark.createDataFrame([], "m string, k string"), "m", "k").count() == 0


def test_bm25_by_hand(spark):
    docs = [("x", 1, "cat cat dog"), ("x", 2, "dog"), ("x", 3, "fish dog")]
    got = bm25_terms(spark.createDataFrame(docs, "c string, id long, t string"), "c", "id", "t", ["cat", "dog", "dog"]).collect()
    import math

    idf = lambda df: math.log(3 - df + 0.5) - math.log(df + 0.5)
    mean = (idf(1) + idf(3) + idf(1)) / 3
    score = lambda w, tf, dl: w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 2))
    want = {(1, "cat"): score(idf(1), 2, 3), (1, "dog"): 2 * score(0.25 * mean, 1, 3), (2, "dog"): 2 * score(0.25 * mean, 1, 1), (3, "dog"): 2 * score(0.25 * mean, 1, 2)}
    assert {(r["id"], r["term"]): round(r["score"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_shingle_pairs_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    docs = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(60)] if i % 4 == 0 else list(docs[-1][1].split())
        if i % 4:
            base[rng.randrange(60)] = rng.choice(words)
        docs.append((i, " ".join(base)))
    docs += [(100, ""), (101, "a b"), (102, docs[0][1])]
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in docs if (w := t.split())}
    first = {}
    for i, t in docs:
        first.setdefault(t, i)
    reps = sorted(i for i in set(first.values()) if i in sets)
    want = {(a, b) for a in reps for b in reps if a != b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    got = shingle_pairs(spark.createDataFrame(docs, "id long, t string"), "id", "t", F.lit(True)).collect()
    assert {(r["query_id"], r["match_id"]) for r in got} == want and want


def test_small_operators(spark):
    df = spark.createDataFrame([("p", 1, 1, "A"), ("p", 1, 2, None), ("p", 2, 1, None), ("p", 3, 1, "B"), ("q", 1, 1, None)], "g string, page int, o int, v string")
    got = {(r["g"], r["page"], r["o"]): r["f"] for r in forward_fill(df, "g", "page", ["o"], F.col("v"), "f").collect()}
    assert got == {("p", 1, 1): "A", ("p", 1, 2): "A", ("p", 2, 1): "A", ("p", 3, 1): "B", ("q", 1, 1): None}
    kept = keep_last(spark.createDataFrame([(1, 1, "a"), (1, 3, None), (2, 0, "z")], "k int, t int, v string"), ["k"], ["t"]).collect()
    assert {(r["k"], r["t"], r["v"]) for r in kept} == {(1, 3, None), (2, 0, "z")}
    sweep = threshold_sweep(spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.6), (0, 0.55)], "t int, s double"), "t", "s").collect()
    best = max(sweep, key=lambda r: (r["macro_f1"], -r["threshold"]))
    assert len(sweep) == 181 and best["macro_f1"] == 1.0 and round(best["threshold"], 3) == 0.555
    assert varying_columns(spark.createDataFrame([(1, None, 1, None), (2, None, 1, 1)], "a int, b int, c int, d int")) == ["a", "d"]

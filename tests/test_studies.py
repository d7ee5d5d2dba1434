"""Bootstrap intervals against brute force on small tables."""

import hashlib

import numpy as np
import pytest
from conftest import SMALL

from lodestack.operators import ranking as R
from lodestack.plans import studies


def drawn_ci(values, replicates, seed, *by):
    """2.5 and 97.5 percent of the means of ``replicates`` resamples, drawn one by one."""
    n = len(values)
    at = lambda r, i: int(hashlib.md5(":".join(map(str, (seed, *by, r, i))).encode()).hexdigest()[:8], 16) % n
    means = [np.mean([values[at(r, i)] for i in range(1, n + 1)]) for r in range(1, replicates + 1)]
    return np.quantile(means, [0.025, 0.975])


def test_bootstrap_takes_ten_thousand_replicates(spark):
    rows = studies._ranks(spark, SMALL).where("model = 1").orderBy("trial").collect()
    got = {r["feature"]: r for r in studies.bootstrap_ci(spark, SMALL).where("model = 1").collect()}
    for feature in sorted(got)[:2]:
        want = drawn_ci([r["borda"] for r in rows if r["feature"] == feature], 10_000, "20260909", 1, feature)
        assert [got[feature]["ci_lower"], got[feature]["ci_upper"]] == pytest.approx(list(want), abs=1e-6)


def test_bootstrap_counts_replicates_of_a_part_block(spark):
    df = spark.createDataFrame([("a", i, float(i * i)) for i in range(7)] + [("b", 0, 3.0)], "g string, t int, v double")
    got = {r["g"]: r for r in R.bootstrap_mean(df, ["g"], "t", "v", R.BLOCK + 3, "s").collect()}
    want = drawn_ci([float(i * i) for i in range(7)], R.BLOCK + 3, "s", "a")
    assert [got["a"]["ci_lower"], got["a"]["ci_upper"]] == pytest.approx(list(want))
    assert got["b"]["ci_lower"] == got["b"]["ci_upper"] == got["b"]["mean"] == 3.0


def test_paired_delta_by_model_and_feature(spark):
    import pandas as pd
    import pyarrow.parquet as pq

    e = pq.read_table(f"{SMALL}/events.parquet").to_pandas()
    us = pd.to_datetime(e["ts"], utc=True).astype("datetime64[us, UTC]").astype("int64")
    e["late"] = us >= (us.min() + us.max()) // 2
    g = e.groupby(["late", "user_id", "event_type"])["value"].sum().round(6).reset_index().sort_values(["late", "user_id", "value", "event_type"], ascending=[True, True, False, True])
    trial = g.groupby(["late", "user_id"])
    k = trial["value"].transform("size")
    g["borda"] = (k - 1 - trial.cumcount()) / (k - 1)
    w = g.pivot(index=["user_id", "event_type"], columns="late", values="borda").dropna().reset_index()
    got = {(r["model"], r["feature"]): r for r in studies.paired_delta_ci(spark, SMALL).collect()}
    assert len(got) == 20
    for (model, feature), x in list(w.groupby([w["user_id"] % 4, "event_type"]))[:3]:
        x, r = x.sort_values("user_id"), got[model, feature]
        assert [r["before"], r["after"], r["delta"], r["n"]] == pytest.approx([x[False].mean(), x[True].mean(), (x[True] - x[False]).mean(), len(x)], abs=2e-6)
        want = drawn_ci(list(x[True] - x[False]), 10_000, "20260909", model, feature)
        assert [r["ci_lower"], r["ci_upper"]] == pytest.approx(list(want), abs=2e-6)


def test_mean_tau_of_resampled_trials(spark):
    """Against drawing trials one by one and taking every pair, as the reference does."""
    rng = np.random.default_rng(3)
    orders = ["".join(rng.permutation(list("abcd"))) for _ in range(12)] + ["abcd"] * 6
    rows = [(0, t, c, i + 1) for t, o in enumerate(orders) for i, c in enumerate(o)]
    classes = R.ranking_classes(spark.createDataFrame(rows, "model int, trial int, item string, rank int"), "model", "trial", "item")
    got = R.bootstrap_tau(classes, "model", 10_000, 1).collect()[0]
    place = [[o.index(c) for c in "abcd"] for o in orders]
    pairs = [(x, y) for x in range(4) for y in range(x)]
    tau = np.array([[sum(np.sign((a[x] - a[y]) * (b[x] - b[y])) for x, y in pairs) / 6 for b in place] for a in place])
    i, j = np.triu_indices(len(orders), 1)
    drawn = rng.integers(0, len(orders), (10_000, len(orders)))
    want = np.quantile(tau[drawn[:, i], drawn[:, j]].mean(1), [0.025, 0.975])
    assert got["mean_tau"] == pytest.approx(tau[i, j].mean()) and got["n_trials"] == 18
    assert [got["ci_lower"], got["ci_upper"]] == pytest.approx(list(want), abs=0.02)


def test_mean_tau_is_that_of_the_summary(spark):
    a, b = ({r["model"]: r["mean_tau"] for r in q(spark, SMALL).collect()} for q in (studies.kendall_summary, studies.kendall_summary_ci))
    assert a == pytest.approx(b, abs=2e-6)

"""Choice of varied compounds against brute force."""

import random

import pytest

from lodestack.plans import records

RNG = random.Random(0)
ROWS = [(f"c{i:02d}", ["0D", "1D"][i % 2], RNG.sample(["F", "Cl", "Br", "I"], RNG.choice([0, 1, 1, 2, 3])), RNG.choice(["III", "V", "III/V", None])) for i in range(30)]


def chosen(cls):
    left = [(c, set(h), o or "") for c, d, h, o in ROWS if (d != "0D") == bool(cls)]
    taken = []
    while len(taken) < 6:

        def score(r):
            sim = max((len(r[1] & t[1]) / len(r[1] | t[1]) if r[1] | t[1] else 0.0 for t in taken), default=0.0)
            new = lambda f: f(r) not in [f(t) for t in taken]
            return round(1 - sim + 0.45 * new(lambda t: t[2]) + 0.35 * new(lambda t: sorted(t[1])) + 0.20 * new(lambda t: len(t[1]) > 1), 9), r[0]

        best = max((r for r in left if r not in taken), key=score)
        taken.append(best)
    return [t[0] for t in taken]


@pytest.mark.parametrize("cls", [0, 1])
def test_greedy_diverse_brute_force(spark, tmp_path, cls):
    df = spark.createDataFrame(ROWS, "compound_id string, sb_halide_dimensionality_llm string, halides_present array<string>, sb_oxidation_state_reported string")
    df.write.parquet(f"{tmp_path}/compound_records.parquet")
    got = sorted((r["step"], r["compound_id"]) for r in records.greedy_diverse(spark, str(tmp_path)).where(f"cls = {cls}").collect())
    assert [c for _, c in got] == chosen(cls)

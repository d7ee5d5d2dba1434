"""What the learned vectors decide in the scan repair, with and without them."""

import random

import pytest

from lodestack.llm import scans

TOPICS = {
    "A": "crystal anion lattice halide layer corner sharing bridge cation symmetry refined diffraction".split(),
    "B": "router signal network cable packet server channel antenna receiver protocol carrier bandwidth".split(),
}


def planted():
    """(id, text, topic): 'modern' and 'fail' are frequent in A, 'fall' in B. Rare are 'modem' (a word of
    its own, in B), 'rnodern' (misread, in A), and 'fa1l', which is 'fail' in A and 'fall' in B."""
    rng, rows = random.Random(3), []
    for i in range(3000):
        topic = "AB"[i % 2]
        w = [rng.choice(TOPICS[topic]) for _ in range(16)]
        w[5] = ("modern" if i % 4 == 0 else "fail") if topic == "A" else "fall"
        if i % 200 == 101:
            w[5] = "modem"
        if i % 300 == 0:
            w[5] = "rnodern"
        if i % 50 in (2, 3):
            w[5] = "fa1l"
        rows.append((i, " ".join(w), topic, w[5]))
    return rows


def run(spark):
    rows = planted()
    df = spark.createDataFrame([(i, t, None, "paragraph") for i, t, _, _ in rows], "unit_id long, text string, section string, unit_type string")
    got = {r["unit_id"]: r["repaired"].split()[5] for r in scans.repair_units(df).where("field_name = 'text'").collect()}
    want = {i: {"rnodern": "modern", "fa1l": "fail" if topic == "A" else "fall"}.get(w, w) for i, _, topic, w in rows}
    kinds = {"own": [i for i, _, _, w in rows if w == "modem"], "misread": [i for i, _, _, w in rows if w == "rnodern"], "either": [i for i, _, _, w in rows if w == "fa1l"]}
    return {k: sum(got[i] == want[i] for i in ids) / len(ids) for k, ids in kinds.items()}


def test_vectors_tell_ambiguous_words_apart(spark):
    share = run(spark)
    assert share["own"] == 1 and share["misread"] == 1 and share["either"] > 0.9


def test_without_vectors_they_are_lost(spark, monkeypatch):
    monkeypatch.setattr(scans, "SIM_PLAIN", -99.0)
    monkeypatch.setattr(scans, "SIM_LEAST", -99.0)
    share = run(spark)
    assert share["own"] == 0 and share["misread"] == 1
    # and of two corrections the same is taken in every context
    fixer = scans.Repairer({"fa1l": ["fall", "fail"]}, frozenset(), frozenset(), frozenset(), None)
    assert {fixer.repair(f"fa1l {t}", False)[0].split()[0] for _, t, _, _ in planted()} == {"fall"}


@pytest.mark.parametrize("seed", range(5))
def test_glyph_edits_are_the_printed_forms(seed):
    rng = random.Random(seed)
    for _ in range(30):
        word = "".join(rng.choice(["r", "n", "m", "i", "c", "l", "1", "u", "d", "e", "a"]) for _ in range(rng.randrange(6, 12)))
        forms = scans.printed_forms(word)
        for f in rng.sample(sorted(forms), min(40, len(forms))):
            assert scans.glyph_edits(word, f) == forms[f], (word, f)


def test_long_words_are_linked_and_long_runs_are_quick(spark):
    long = "tetrahydronaphthalenecarboxylic"
    misread = long.replace("carboxylic", "carboxyllc")
    rows = [(f"solution of {long} in water", 40), (f"solution of {misread} in water", 1), ("of " + "rnil" * 200 + " in", 1)]
    df = spark.createDataFrame([(i, t, None, "paragraph") for i, t in enumerate(t for t, n in rows for _ in range(n))], "unit_id long, text string, section string, unit_type string")
    got = {r["unit_id"]: r["repaired"] for r in scans.repair_units(df).where("field_name = 'text'").collect()}
    assert got[40] == rows[0][0]

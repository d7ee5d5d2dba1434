"""Results of the scan repair that must not depend on the size of the corpus."""

import random

import pytest

from lodestack.llm import scans

BASE = "the residual electron density of sharing corner between layers journal chains crystals structure remained attractive compound solution exhibits lattice".split()


def corpus():
    rng, rows = random.Random(11), []
    for i in range(500):
        w = [rng.choice(BASE) for _ in range(40)]
        lines = [" ".join(w[j : j + 8]) for j in range(0, 40, 8)]
        if i % 5 == 0:
            lines.insert(rng.randrange(1, 5), "Modern Annals of Invented Notes, Vol. 12")
        rows.append(["\n".join(lines), "Experimental", "paragraph"])
    # rare misreadings: of a header's first word in plain letters, of a word after a kept
    # hyphen, and of halves with a header or page number between
    rows[3][0] = rows[3][0].replace("\n", "\nModem Annals of Invented Notes, Vol. 3\n", 1)
    rows[4][0] = "of the corner-\nsharlng of lattice density between the layers of the structure\nthe chains remained"
    rows[6][0] = "of the layers between the chains of the struc-\nModern Annals of Invented Notes, Vol. 4\nlure remained in the solution of lattice\nthe chains remained"
    rows[8][0] = "of the layers between the chains of the resld-\n- 12 -\nual density of the solution\nthe chains remained"
    rows[9][0] = "of the layers between the chains of the resld-\nModem Annals of Invented Notes, Vol. 9\nual density of the solution\nthe chains remained"
    rows[11][0] = rows[11][0] + "\nthe resldual density"  # only words that stand whole somewhere are linked
    return [(i, *r) for i, r in enumerate(rows)]


def test_links_by_join_give_what_links_by_broadcast_give(spark):
    df = spark.createDataFrame(corpus(), "unit_id long, text string, section string, unit_type string")
    a, b = ({(r["unit_id"], r["field_name"]): (r["repaired"], r["defects"]) for r in scans.repair_units(df, max_links=n).collect()} for n in (scans.MAX_BROADCAST, 0))
    assert a[3, "text"][1] == ["header"] and a[4, "text"][1] == ["chars", "hyphen"] and "residual" in a[8, "text"][0] and "residual" in a[9, "text"][0]
    assert {k: (a[k], b[k]) for k in a if a[k] != b[k]} == {}


def slow_glue(text):
    """All words that any choice of dropped lines can make of adjoining halves."""
    lines, out = text.split("\n"), set()
    for i, x in enumerate(lines):
        for y in lines[i + 1 :]:
            if x[-1] in "-\xad":
                out.add((x.rstrip("-\xad").split(" ")[-1] + y.split(" ")[0].rstrip("-\xad")).lower())
    return out


@pytest.mark.parametrize("seed", range(20))
def test_words_met_holds_all_that_may_be_glued(seed):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice(BASE)[: rng.randrange(2, 9)] for _ in range(rng.randrange(1, 5))) + rng.choice(["", "-", "\xad"]) for _ in range(8)]
    assert slow_glue("\n".join(lines)) <= scans.words_met("\n".join(lines), False)


def test_unseen_words_are_not_known_in_a_large_vocabulary(spark):
    """More distinct known words than a table of fixed size keeps apart, few of them asked for."""
    counts = spark.range(700_000).selectExpr("'w' as kind", "concat('w', id) as a", "'' as b", "5L as n")
    asked = spark.range(600_000, 800_000).selectExpr("'d' as kind", "concat('w', id) as a", "'' as b", "1L as n")
    assert scans.known_words(counts.unionByName(asked)).count() == 100_000


def test_known_words_are_those_asked_for_at_hyphens(spark):
    text = "the edge-\nand corner-\n- 12 -\nsharing struc-\nture"
    df = spark.createDataFrame([(i, text + "\nedge and corner structure", "S", "paragraph") for i in range(9)], "unit_id long, text string, section string, unit_type string")
    known = {r["word"] for r in scans.known_words(scans.count_all(df, "text", "section", "unit_type")).collect()}
    assert {"edge", "and", "corner", "sharing", "structure"} <= known and "edgeand" not in known and "the" not in known


def test_more_furniture_than_can_be_broadcast(spark, monkeypatch):
    """Headers and page stems by join; the limit is far below their number."""
    rows = [*corpus(), *[(900 + i, "a text of the lattice", f"Residual density {'' if i % 3 else i}".strip(), "paragraph") for i in range(9)]]
    df = spark.createDataFrame(rows, "unit_id long, text string, section string, unit_type string")
    found = lambda: {(r["unit_id"], r["field_name"]): (r["repaired"], r["defects"]) for r in scans.repair_units(df).collect()}
    want = found()
    monkeypatch.setattr(scans, "MAX_BROADCAST", 0)
    monkeypatch.setattr(scans.repair_units, "__defaults__", (*scans.repair_units.__defaults__[:-1], 0))
    assert found() == want
    assert ["header"] in [x[1] for x in want.values()] and want[903, "section"] == ("Residual density", ["pageno"])

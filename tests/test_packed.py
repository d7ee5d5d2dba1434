import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestack.operators.packed import parse_packed, unpack


def labels(s):
    return [v for v, _ in parse_packed(s, "label")]


def entries(s):
    return [v for v, _ in parse_packed(s, "entry")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1a, 1b and 2·H2O", ["1a", "1b", "2·H2O"]),
        ('"1a, yellow ""new""" | 2', ['1a, yellow "new"', "2"]),
        ("“1a; form B \"new\"” & 'A2 / low-T'", ['1a; form B "new"', "A2 / low-T"]),
        ("1||2; ;3/", ["1", "2", "3"]),
        ("(1,2), 3", ["(1,2)", "3"]),
        ("2,2'-bipyridine, 3", ["2,2'-bipyridine", "3"]),
        ("", []),
        (" ;; \t", []),
        ('""', []),
    ],
)
def test_labels(text, want):
    assert labels(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("L = aryl group, see scheme 2, tmz: [not, defined]", ["L = aryl group, see scheme 2", "tmz: [not, defined]"]),
        ("\"Q: keto; enol form\" // L' = x;", ["Q: keto; enol form", "L' = x"]),
        ("A = N,N-diallylurea", ["A = N,N-diallylurea"]),
        ("R = (1-H | t = 2; X = 3), B = y", ["R = (1-H | t = 2; X = 3)", "B = y"]),
    ],
)
def test_entries(text, want):
    assert entries(text) == want


def test_malformed_marks_backtrack():
    assert parse_packed('"1a, 1b', "label") == [('"1a', "malformed_quote"), ("1b", None)]
    assert parse_packed("(1a, 1b", "label") == [("(1a", "unbalanced_bracket"), ("1b", None)]
    long = '"' + "x" * 50_000 + ", y"
    assert [v for v, _ in parse_packed(long, "label")] == ['"' + "x" * 50_000, "y"]


@given(st.lists(st.text("ab1'\"(,; ", min_size=1).map(str.strip).filter(bool), min_size=1, max_size=6))
def test_quoted_values_come_back(values):
    packed = " ; ".join('"' + v.replace('"', '""') + '"' for v in values)
    assert labels(packed) == values


def test_unpack_edges(spark):
    rows = [(1, "1a, 1b", None, "x"), (1, "1a, 1b", None, "x"), (2, None, "", "y"), (3, "  ", "A = b", "z")]
    df = spark.createDataFrame(rows, "id long, lab string, glo string, pos string")  # 'pos' clashes with an output
    out = unpack(df, "id", {"lab": "label", "glo": "entry"})
    assert sorted(tuple(r)[:4] for r in out.collect()) == [(1, "lab", 1, "1a"), (1, "lab", 1, "1a"), (1, "lab", 2, "1b"), (1, "lab", 2, "1b"), (3, "glo", 1, "A = b")]
    assert unpack(df.limit(0), "id", {"lab": "label"}).count() == 0


def test_parse_is_linear_in_the_text():
    import time

    for text in ("(a;", "; ", '"a; ', "1,", "[(]", "a = b; ", "'; ", '""'):
        for kind in ("label", "entry"):
            began = time.time()
            parse_packed(text * 16_000, kind)
            assert time.time() - began < 5, (text, kind)

import random
from datetime import datetime, timedelta

from lodestack.operators.orphans import OrphanStore, find_orphans, parent_rows, reference_rows

T0 = datetime(2024, 1, 1)


def brute(refs, parents):
    out = set()
    for rid, key, at in refs:
        k = (key or "").strip().lower()
        if not k:
            continue
        rows = [p for p in parents if (p[0] or "").strip().lower() == k]
        if not rows:
            out.add((rid, key, "missing"))
        elif max(rows, key=lambda p: (p[1] is not None, p[1] or T0, p[2]))[3]:
            out.add((rid, key, "deleted"))
        elif at and any(p[1] for p in rows) and min(p[1] for p in rows if p[1]) > at:
            out.add((rid, key, "late"))
    return out


def test_batches_agree_with_brute_force(spark):
    rng = random.Random(3)
    when = lambda: None if rng.random() < 0.1 else T0 + timedelta(days=rng.randrange(100))
    parents = [(rng.choice(["a", "A ", "b", "c", "d", None, " "]), when(), i, rng.random() < 0.3) for i in range(40)]
    refs = [(i, rng.choice(["a", " B", "c", "D", "e", "", None]), when()) for i in range(60)]
    p = parent_rows(spark.createDataFrame(parents, "k string, at timestamp, seq long, gone boolean"), "t", "k", "at", "seq", "gone")
    r = reference_rows(spark.createDataFrame(refs, "id long, k string, at timestamp"), "refs", "id", "k", "t", "at")
    want = brute(refs, parents)
    for cuts in (None, [T0 + timedelta(days=30)], [T0 + timedelta(days=x) for x in (20, 50, 80)]):
        got = {(x["row_id"], x["ref_key"], x["reason"]) for x in find_orphans(r, p, cuts).open.collect()}
        assert got == want, cuts


def test_empty_tables(spark):
    p = parent_rows(spark.createDataFrame([], "k string, at timestamp, seq long, gone boolean"), "t", "k", "at", "seq", "gone")
    refs = spark.createDataFrame([(1, ["x", "x", None], "2024-01-01T00:00:00")], "id long, k array<string>, at string")
    r = reference_rows(refs, "refs", "id", "k", "t", "at")
    assert [(x["row_id"], x["reason"]) for x in find_orphans(r, p).open.collect()] == [(1, "missing")]
    assert find_orphans(r.limit(0), p, [T0]).counts().count() == 0


def test_store_goes_on_after_a_restart_and_costs_by_batch(spark, tmp_path):
    rng = random.Random(4)
    make_p = lambda rows: parent_rows(spark.createDataFrame(rows, "k string, at timestamp, seq long, gone boolean"), "t", "k", "at", "seq", "gone")
    make_r = lambda rows: reference_rows(spark.createDataFrame(rows, "id long, k string, at timestamp"), "refs", "id", "k", "t", "at")
    when = lambda: None if rng.random() < 0.1 else T0 + timedelta(days=rng.randrange(100))
    parents, refs, took = [], [], []
    for n in range(6):
        p = [(f"k{rng.randrange(12)}", when(), 100 * n + i, rng.random() < 0.3) for i in range(4)]
        r = [(100 * n + i, f"K{rng.randrange(14)} ", when()) for i in range(5)]
        parents, refs = parents + p, refs + r
        store = OrphanStore(spark, str(tmp_path / "state"), parts=8)  # opened anew each time
        assert store.apply(make_r(r), make_p(p), n) and not store.apply(make_r(r), make_p(p), n)
        store.snapshot(T0 + timedelta(days=n))
        took.append({x for x in store.manifest["where"].values() if x == n + 1})
    store = OrphanStore(spark, str(tmp_path / "state"))
    assert {(x["row_id"], x["ref_key"], x["reason"]) for x in store.open().collect()} == brute(refs, parents)
    assert sum(x["n"] for x in store.counts().collect()) == store.open().count()
    assert spark.read.parquet(str(tmp_path / "state/snapshots")).select("taken_at").distinct().count() == 6
    # a batch of one key rewrites one part
    before = dict(store.manifest["where"])
    store.apply(make_r([(999, "k3", None)]), make_p([("k3", T0, 999, False)]), "one")
    assert sum(store.manifest["where"][k] != before.get(k) for k in store.manifest["where"]) == 1

"""Splits that keep related records together (problem 4).

Records that share a key form components. Components of the same size and label
profile (how many records of each label) are one bundle. How many of a bundle go
to each split is one min-cost flow over all bundles: each sends its components to
the splits, and the cost is the squared deviation of the splits' records, and of
each label's records, from their quotas. The proportional flow costs nothing but
is not whole; it is rounded down, the rest is sent along the cheapest arcs, the
largest components first, and then cycles of negative cost are cancelled until
none is left: a component moves to another split, or two change places. Which of
a bundle's components go where is decided by hash.

Bundles are read on the driver in descending size, MAX_BUNDLES at a time; where
there are more, the flow of a part goes on from the loads of the parts before.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected_components
from ..operators.skew import hash_slice, join_unique, ranked
from ..session import settle

#: So many bundles are solved together.
MAX_BUNDLES = 500_000
#: Rounds of cycle cancelling at most; each lowers the cost, and few are needed.
MAX_ROUNDS = 50
#: Weight of the deviation of a label's own shares against that of the whole.
LABEL_WEIGHT = 0.1

# Names that link nothing.
NO_NAME = ["", "-", "n/a", "notreported"]


def group_keys(df: DataFrame, member: str, paper: str, names: str) -> DataFrame:
    """(member, key) of each record: its paper and each of its names, compared
    without letter case and blanks. Null, blank and meaningless keys are null."""
    name = F.lower(F.regexp_replace("n", r"[\s ]+", ""))
    by_name = df.select(member, F.explode_outer(names).alias("n")).select(member, F.when(~name.isin(NO_NAME), F.concat(F.lit("n:"), name)).alias("key"))
    by_paper = df.select(member, F.when(F.length(F.trim(paper)) > 0, F.concat(F.lit("p:"), F.col(paper))).alias("key"))
    return by_paper.unionByName(by_name)


def find_groups(df: DataFrame, member: str, paper: str, names: str) -> DataFrame:
    """member, component; see connected_components for nulls, ties and empty tables."""
    return connected_components(group_keys(df, member, paper, names), member, "key")


class Flow:
    """Loads of the splits, in all and by label, and the flow of bundles into them."""

    def __init__(self, shares: list[float], total: float, by_label: dict[str, float]):
        self.share = np.array(shares) / (sum(shares) or 1.0)
        self.labels = {x: i for i, x in enumerate(sorted(by_label))}
        # row 0 is all records, the others are labels; a deviation of a label counts LABEL_WEIGHT
        amount = np.array([total, *[by_label[x] for x in sorted(by_label)]], float)
        self.over = -np.outer(amount, self.share)  # load less quota
        self.weight = np.array([1.0, *[LABEL_WEIGHT] * len(by_label)])

    def vector(self, size: int, profile: str) -> np.ndarray:
        """What one component of a bundle adds to each row."""
        v = np.zeros(len(self.weight))
        v[0] = size
        for part in profile.split(";") if profile else []:
            label, n = part.rsplit("=", 1)
            v[1 + self.labels[label]] = float(n)
        return v

    def cost(self) -> float:
        return float(self.weight @ (self.over**2).sum(1))

    def solve(self, bundles: list[tuple[int, str, int]]) -> np.ndarray:
        """Components of each bundle to each split."""
        v = np.array([self.vector(size, profile) for size, profile, _ in bundles]).reshape(len(bundles), len(self.weight))
        n = np.array([b[2] for b in bundles], np.int64)
        flow = np.floor(np.outer(n, self.share) + 1e-9).astype(np.int64)
        self.over += v.T @ flow
        for i in np.argsort(-v[:, 0], kind="stable"):
            for _ in range(int(n[i] - flow[i].sum())):
                gain = self.weight @ (2 * self.over * v[i][:, None] + (v[i] ** 2)[:, None])
                s = int(np.argmin(np.round(gain, 6)))
                flow[i, s] += 1
                self.over[:, s] += v[i]
        for _ in range(MAX_ROUNDS):
            if not self._cancel(v, flow):
                break
        return flow

    def _cancel(self, v: np.ndarray, flow: np.ndarray) -> bool:
        """One pass over all cycles of two arcs, and of four between a bundle and the
        best partner of each pair of splits; whether any lowered the cost."""
        moved, k = False, len(self.share)
        for s in range(k):
            for t in range(k):
                if s == t:
                    continue
                # moving one component from s to t changes the cost by w.(2 (over_t - over_s) v + 2 v^2)
                while True:
                    d = self.weight * (self.over[:, t] - self.over[:, s])
                    change = 2 * (v @ d) + 2 * (v**2 @ self.weight)
                    change = np.where(flow[:, s] > 0, change, np.inf)
                    i = int(np.argmin(change)) if len(change) else -1
                    if i < 0 or change[i] >= -1e-6:
                        break
                    self._shift(v, flow, i, s, t)
                    moved = True
                if s < t and len(v):
                    # two components change places: the difference of their vectors moves
                    d = self.weight * (self.over[:, t] - self.over[:, s])
                    there = np.where(flow[:, s] > 0, 2 * (v @ d), np.inf)
                    back = np.where(flow[:, t] > 0, -2 * (v @ d), np.inf)
                    for i in np.argsort(there)[:64]:
                        if not np.isfinite(there[i]):
                            break
                        both = there[i] + back + 2 * ((v[i] - v) ** 2 @ self.weight)
                        j = int(np.argmin(both))
                        if both[j] < -1e-6:
                            self._shift(v, flow, int(i), s, t)
                            self._shift(v, flow, j, t, s)
                            moved = True
                            break
        return moved

    def _shift(self, v: np.ndarray, flow: np.ndarray, i: int, s: int, t: int) -> None:
        flow[i, s] -= 1
        flow[i, t] += 1
        self.over[:, s] -= v[i]
        self.over[:, t] += v[i]


def allocate(bundles: Iterable[tuple[int, str, int]], shares: list[tuple[str, float]]) -> dict[tuple[int, str], list[int]]:
    """How many of the n components of each bundle (size, profile, n) go to each split.
    A profile is 'label=records' parts joined by ';', or empty."""
    rows = sorted(bundles, key=lambda b: (-b[0], b[1]))
    flow = Flow([w for _, w in shares], sum(b[0] * b[2] for b in rows), _label_totals(rows))
    out = flow.solve(rows)
    return {(b[0], b[1]): x.tolist() for b, x in zip(rows, out)}


def _label_totals(rows: Iterable[tuple[int, str, int]]) -> dict[str, float]:
    total: dict[str, float] = {}
    for _, profile, n in rows:
        for part in profile.split(";") if profile else []:
            label, k = part.rsplit("=", 1)
            total[label] = total.get(label, 0.0) + n * float(k)
    return total


def assign_splits(groups: DataFrame, member: str, labels: DataFrame | None, targets: DataFrame, seed: int = 17) -> DataFrame:
    """member, component, split for ``groups`` (member, component).

    ``labels`` (member, label) may hold several labels of a member; a component's
    profile counts its members of each label, and null labels have no part in it.
    ``targets`` (split, target_share) may hold any number of splits; null or negative
    shares count as 0. The result depends on ids and seed only, not on the order or
    partitioning of rows. No members give no rows; no targets give a null split.
    """
    spark = groups.sparkSession
    g = groups.select(member, "component").distinct()
    comps = g.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    if labels is not None:
        # ';' and '=' part the profile
        clean = F.regexp_replace(F.col("label").cast("string"), "[;=]", "_")
        votes = join_unique(labels.select(member, clean.alias("label")).where("label is not null").distinct(), g, member, "inner")
        votes = votes.groupBy("component", "label").agg(F.count(F.lit(1)).alias("v"))
        part = F.concat("label", F.lit("="), F.col("v").cast("string"))
        comps = join_unique(comps, votes.groupBy("component").agg(F.array_join(F.array_sort(F.collect_list(part)), ";").alias("profile")), "component")
    else:
        comps = comps.withColumn("profile", F.lit(None).cast("string"))
    comps = settle(comps.withColumn("profile", F.coalesce("profile", F.lit(""))), "components")
    bundled = settle(comps.groupBy("size", "profile").agg(F.count(F.lit(1)).alias("n")), "bundles")
    shares = [(r["split"], max(0.0, r["target_share"] or 0.0)) for r in targets.orderBy("split").collect()]
    if not shares:
        return g.withColumn("split", F.lit(None).cast("string"))
    # totals of the labels: as many rows as there are labels
    each = bundled.where("profile <> ''").select("n", F.explode(F.split("profile", ";")).alias("p"))
    totals = each.groupBy(F.substring_index("p", "=", 1).alias("label")).agg(F.sum(F.col("n") * F.substring_index("p", "=", -1).cast("double")).alias("total")).collect()
    size = bundled.agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0))).first()[0]
    flow = Flow([w for _, w in shares], float(size), {r["label"]: r["total"] for r in totals})
    quota = None
    part: list[tuple[int, str, int]] = []
    schema = T.StructType.fromDDL("size long, profile string, lo long, hi long, split string")

    def solved(part: list[tuple[int, str, int]]) -> DataFrame:
        rows = []
        for (size, profile, _), counts in zip(part, flow.solve(part)):
            lo = 0
            for (split, _), k in zip(shares, counts.tolist()):
                if k:
                    rows.append((size, profile, lo, lo + k, split))
                    lo += k
        return settle(spark.createDataFrame(rows, schema), "quota")

    for r in bundled.orderBy(F.desc("size"), "profile").toLocalIterator():
        part.append(tuple(r))
        if len(part) == MAX_BUNDLES:
            quota = solved(part) if quota is None else quota.unionByName(solved(part))
            part = []
    if part or quota is None:
        quota = solved(part) if quota is None else quota.unionByName(solved(part))
    key = F.concat(F.col("component").cast("string"), F.lit(f"#{seed}"))
    placed = ranked(comps, ["size", "profile"], [F.md5(key), F.col("component")], hash_slice(key), "rank")
    placed = placed.join(quota, ["size", "profile"]).where("rank > lo and rank <= hi").select("component", "split")
    return join_unique(g, placed, "component").select(member, "component", "split")


def split_report(assigned: DataFrame, member: str, labels: DataFrame, targets: DataFrame) -> DataFrame:
    """split, label ('*': all), n, target_share, actual_share, deviation (records over the quota)."""
    rows = assigned.select(member, "split").where("split is not null")
    each = rows.join(labels.select(member, F.col("label").cast("string").alias("label")).where("label is not null").distinct(), member)
    n = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select("split", F.lit("*").alias("label"), "n").unionByName(each.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n")))
    total = n.groupBy("label").agg(F.sum("n").alias("all"))
    grid = total.join(targets.select("split", "target_share"))
    out = grid.join(n, ["split", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("split", "label", "n", "target_share", (F.col("n") / F.col("all")).alias("actual_share"), (F.col("n") - F.col("target_share") * F.col("all")).alias("deviation"))


def broken_rule(groups: DataFrame, member: str, assigned: DataFrame) -> DataFrame:
    """Members of ``assigned`` (member, split) with a split whose component holds
    two or more different splits. Null splits and members without group are none."""
    rows = assigned.where("split is not null").select(member, "split").join(groups.hint("merge"), member)
    mixed = rows.groupBy("component").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select("component")
    return rows.join(mixed.hint("merge"), "component", "left_semi").select(member).distinct()



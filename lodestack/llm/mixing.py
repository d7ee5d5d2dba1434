"""Mixing sources to target weights (problem 9) by pivotal dependent rounding.

The largest mixture is taken in which every source keeps its share and none is
used more often than allowed: a source of T tokens with share w and cap m allows
a mixture of m*T/w tokens, and the scarcest source decides. A document is used
floor(r) times and once more with probability frac(r), r being its source's
rate. Those probabilities are rounded in pairs: of two fractional documents one
gives token mass to the other until one of them is integral, in the direction
that keeps the expectation of both. Tasks round their documents and leave at
most one fractional document a source; those residuals meet in a reduction tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

#: Residuals of so many tasks meet in one task of the next level of the tree.
FAN_IN = 64
#: Documents a task rounds at most, about.
DOCS_PER_TASK = 200_000

_OUT = "doc_id long, source string, n_tokens long, base int, p double, u double, extra int, left boolean, part int"


def source_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Rates of the sources: source, n_docs, tokens, target_share, max_repeats, rate.

    ``sizes`` (source, n_docs, tokens) has a row a source, ``targets`` (source,
    target_share, max_repeats). A source with no target, a null one included, or
    without tokens gets rate 0, and so does a target share or cap that is null or
    not positive. A target without documents is listed with zeros; it can't bind.
    One row a source, and one global minimum of two numbers: nothing is collected.
    """
    joined = sizes.join(targets, "source", "full")
    ok = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    room = F.when(ok, F.col("max_repeats") * F.col("tokens") / F.col("target_share"))
    total = joined.select(F.min(room).alias("mix_tokens"))
    rate = F.when(ok, F.least(F.col("max_repeats").cast("double"), F.col("target_share") * F.col("mix_tokens") / F.col("tokens"))).otherwise(F.lit(0.0))
    return joined.crossJoin(F.broadcast(total)).select(
        "source", F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"), F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"), "target_share", "max_repeats", rate.alias("rate")
    )


def pivot(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Round probabilities ``p`` of documents of ``size`` tokens in pairs, with
    uniform numbers ``u``: (0 or 1 for each but the residual, index of the residual
    or -1). Token mass sum(p*size) is kept but for the residual's."""
    p = p.astype(float).copy()
    hold = -1
    for i in range(len(p)):
        if p[i] <= 1e-12 or p[i] >= 1 - 1e-12:
            p[i] = round(p[i])
            continue
        if hold < 0:
            hold = i
            continue
        j, ratio = hold, size[hold] / size[i]
        up = min(1 - p[j], p[i] / ratio)
        down = min(p[j], (1 - p[i]) / ratio)
        step = up if u[i] * (up + down) < down else -down
        p[j] += step
        p[i] -= step * ratio
        for k in (i, j):
            if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                p[k] = round(p[k])
        hold = j if 0 < p[j] < 1 else i if 0 < p[i] < 1 else -1
    return p, hold


def _round_part(final: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, pd.DataFrame] = {}
        for f in frames:
            out = []
            for source, g in f.groupby("source", sort=True):
                g = pd.concat([held.pop(source), g], ignore_index=True) if source in held else g.reset_index(drop=True)
                p, hold = pivot(g["p"].to_numpy(), g["n_tokens"].to_numpy(), g["u"].to_numpy())
                g = g.assign(p=p, extra=np.round(p).astype("int32"), left=False)
                if hold >= 0:
                    held[source] = g.iloc[[hold]].assign(p=p[hold])
                    g = g.drop(index=hold)
                out.append(g)
            if out:
                yield pd.concat(out)
        if held:
            rest = pd.concat([held[s] for s in sorted(held)])
            if final:  # one residual a source in all: it is used by its own probability
                yield rest.assign(extra=(rest["u"] < rest["p"]).astype("int32"), left=False)
            else:
                yield rest.assign(left=True)

    return run


def draw_copies(docs: DataFrame, rates: DataFrame, seed: int = 29) -> DataFrame:
    """doc_id, source, n_tokens, copies for each document of ``docs`` (doc_id,
    source, n_tokens); documents of sources with rate 0 get 0 copies.

    The draw depends on ids and seed only. Documents without tokens are used as
    often as the whole part of the rate. Repeated doc_ids are rounded as rows.
    """
    spark = docs.sparkSession
    h = F.xxhash64("doc_id", F.lit(seed))
    rate = F.coalesce("rate", F.lit(0.0))
    # a row a source: Spark broadcasts it if it is small, else hot sources are split in the merge join
    rows = docs.join(rates.where("rate > 0").select("source", "rate"), "source", "left").select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "n_tokens", F.floor(rate).cast("int").alias("base"), (rate - F.floor(rate)).alias("p"), (F.pmod(h, F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("u"), h.alias("h")
    )
    rows = settle(rows, "mix")
    open_rows = rows.where("p > 0 and n_tokens > 0 and source is not null")
    n = open_rows.count()
    parts = max(1, -(-n // DOCS_PER_TASK), min(spark.sparkContext.defaultParallelism, n // 2000))
    cols = ["doc_id", "source", "n_tokens", "base", "p", "u"]
    level = open_rows.repartition(parts, "h").sortWithinPartitions("source", "h", "doc_id").select(*cols, F.lit(0).alias("extra"), F.lit(False).alias("left"), F.lit(0).alias("part"))
    done = rows.where("not (p > 0 and n_tokens > 0 and source is not null)").select("doc_id", "source", "n_tokens", F.col("base").alias("copies"))
    while True:
        final = parts == 1
        out = settle(level.mapInPandas(_round_part(final), _OUT).withColumn("part", F.spark_partition_id()), "round")
        done = done.unionByName(out.where("not left").select("doc_id", "source", "n_tokens", (F.col("base") + F.col("extra")).alias("copies")))
        if final:
            return done
        parts = -(-parts // FAN_IN)
        level = out.where("left").repartition(parts, F.floor(F.col("part") / FAN_IN)).sortWithinPartitions("source", "u", "doc_id")


def mix_report(docs: DataFrame, targets: DataFrame, seed: int = 29) -> tuple[DataFrame, DataFrame]:
    """(copies of each document, report by source): the report has source, n_docs,
    tokens, target_share, max_repeats, rate, uses (copies of its documents in the
    mixture), used_tokens and actual_share. An empty table gives only the targets,
    with zeros; the actual share is 0 where nothing is used."""
    docs = settle(docs.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens")), "sized")
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    rates = settle(source_rates(sizes, targets), "rates")
    copies = draw_copies(docs, rates, seed)
    used = copies.groupBy("source").agg(F.sum("copies").alias("uses"), F.sum(F.col("copies") * F.col("n_tokens")).alias("used_tokens"))
    total = used.select(F.sum("used_tokens").alias("all"))
    report = rates.join(used, rates["source"].eqNullSafe(used["source"]), "left").crossJoin(F.broadcast(total)).select(
        rates["source"], "n_docs", "tokens", "target_share", "max_repeats", "rate", F.coalesce("uses", F.lit(0).cast("long")).alias("uses"), F.coalesce("used_tokens", F.lit(0).cast("long")).alias("used_tokens"), F.coalesce(F.col("used_tokens") / F.nullif("all", F.lit(0)), F.lit(0.0)).alias("actual_share")
    )
    return copies, report

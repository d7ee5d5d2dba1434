"""Structured external calls with a content-addressed ledger, and the record stages on top.

A call takes a prompt and gives a JSON string. Results are kept in a ledger table
keyed by a hash of system text, prompt and schema; only prompts that the ledger
lacks are called, once each however many rows ask it. The default call is offline
and gives the stage's stub.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_tokens
from ..session import settle
from .retrieval import bm25_queries, bm25_weights, top_per_group

Call = Callable[[str], str]
LEDGER = "key string, prompt string, response string, error string"

# What a stage returns without a model.
STUBS = {
    "screen": '{"candidates": []}',
    "registry": '{"compounds": []}',
    "relevance": '{"is_relevant": true, "relevance_type": "dry_run_stub"}',
    "dossier": '{"not_reported": true, "evidence_text": ""}',
    "cation": '{"cations": []}',
    "glossary": '{"abbreviations": []}',
    "dimensionality": '{"sb_halide_dimensionality_llm": "Unknown", "dimensionality_evidence_status": "insufficient", "halides_present": [], "halides_bonded_to_sb": []}',
    "verify": '{"field_checks": [], "failed_fields": [], "recovery_queries": [], "overall_status": "incomplete_or_conflicting"}',
}
# Which evidence to fetch again for a field that failed verification.
FIELD_CATEGORY = {"cation_name": "cation", "cation_formula": "cation", "connectivity_evidence": "connectivity", "dimensionality_label": "connectivity", "synthesis_target": "synthesis"}


def stub(stage: str) -> Call:
    return lambda prompt: STUBS[stage]


def call_all(rows: DataFrame, prompt: str, call: Call, ledger: str, system: str = "", schema: str = "", attempts: int = 3, required: tuple[str, ...] = (), backoff: float = 0.0, longest: float = 30.0) -> DataFrame:
    """``rows`` with response and error; new answers are appended to ``ledger`` (a parquet
    folder). An answer must be a JSON object with the ``required`` keys; else, and after
    an error, it is asked again, waiting min(backoff * 2^k, longest) seconds before
    attempt k + 1. An error named QuotaExhausted is not tried again."""
    spark = rows.sparkSession
    keyed = rows.withColumn("__key", F.sha2(F.concat_ws("\x1f", F.lit(system), F.lit(schema), F.col(prompt)), 256))
    done = read_ledger(spark, ledger)
    todo = keyed.where(F.col(prompt).isNotNull()).select(F.col("__key").alias("key"), F.col(prompt).alias("prompt")).dropDuplicates(["key"]).join(done.where("error is null").select("key").distinct(), "key", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, text in zip(f["key"], f["prompt"]):
                answer, error = None, None
                for k in range(attempts):
                    if k and backoff:
                        time.sleep(min(backoff * 2**k, longest))
                    try:
                        answer = checked(call(text), required)
                        error = None
                        break
                    except Exception as e:  # noqa: BLE001 - the ledger keeps what went wrong
                        answer, error = None, f"{type(e).__name__}: {e}"[:500]
                        if type(e).__name__ == "QuotaExhausted":
                            break
                out.append((key, text, answer, error))
            yield pd.DataFrame(out, columns=["key", "prompt", "response", "error"])

    todo.mapInPandas(run, LEDGER).write.mode("append").parquet(ledger)
    latest = read_ledger(spark, ledger).groupBy("key").agg(F.max(F.struct(F.col("error").isNull().alias("ok"), "response", "error")).alias("r"))
    return keyed.join(latest.withColumnRenamed("key", "__key"), "__key", "left").select(*rows.columns, "r.response", "r.error")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    from ..sources.files import _exists

    if not _exists(spark, f"{path.rstrip('/')}/*.parquet"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def checked(answer: str, required: tuple[str, ...]) -> str:
    """``answer`` itself if it is a JSON object with the required keys."""
    if required:
        found = json.loads(answer)
        if not isinstance(found, dict):
            raise ValueError("answer is no JSON object")
        if lacking := sorted(set(required) - found.keys()):
            raise ValueError(f"answer lacks {', '.join(lacking)}")
    return answer


def retry_queries(failed: Column, recovery: Column) -> Column:
    """map<category,query>: of the failed fields that have a recovery query, the first of
    each category of evidence; empty if there is none."""
    category = F.create_map(*[F.lit(x) for pair in FIELD_CATEGORY.items() for x in pair])
    has = F.filter(failed, lambda f: F.try_element_at(category, f).isNotNull() & F.try_element_at(recovery, f).isNotNull())
    pairs = F.transform(has, lambda f: F.struct(F.try_element_at(category, f).alias("k"), F.try_element_at(recovery, f).alias("v")))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(first)


def retrieve_again(open_: DataFrame, index: tuple[DataFrame, DataFrame], key: str, paper: str, queries: str, seen: str, top: int = 20, fresh: int = 10) -> DataFrame:
    """``key``, category, new_ids for each query of the map column ``queries``: of the
    ``top`` units of the record's own paper by BM25, the first ``fresh`` that are not in
    the map column ``seen`` (category -> source ids). Queries without new units are left out."""
    q = open_.select(key, paper, seen, F.explode(queries).alias("category", "query_text"))
    q = q.select(F.concat_ws("\x1f", F.col(key).cast("string"), "category").alias("query"), key, "category", F.col(paper).alias("corpus"), F.coalesce(F.try_element_at(F.col(seen), F.col("category")), F.array().cast("array<string>")).alias("had"), ascii_tokens(F.col("query_text")).alias("terms"))
    hits = bm25_queries(index, q.select("query", "corpus", "terms"), "corpus", "doc")
    hits = top_per_group(hits, ["query"], [F.desc("score"), "doc"], top)
    kept = hits.join(q.select("query", key, "category", "had"), "query").where(~F.array_contains("had", F.col("doc")))
    kept = top_per_group(kept.drop("rank"), ["query"], [F.desc("score"), "doc"], fresh)
    return kept.groupBy(key, "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("new_ids"))


def repair_loop(records: DataFrame, verify: Callable[[DataFrame], DataFrame], redo: Callable[[DataFrame], DataFrame], units: DataFrame | None = None, cycles: int = 2, key: str = "id", paper: str = "paper_id") -> DataFrame:
    """Verify, and for at most ``cycles`` rounds fetch evidence again for what failed, redo
    it and verify it again. Each round works on the rows that still fail only.

    ``verify`` adds status ('supported' or other), failed_fields (array), recovery (map
    of field to query) and notes. With ``units`` (corpus, doc, text), a row is tried
    again only if a failed field has a query and a category of evidence; the units found
    are given to ``redo`` as the map new_evidence (category -> ids), and are added to the
    map sources. Without, every failing row is redone. A row that is not supported in the
    end and whose label failed gets label Unknown and the reason; cycle counts the rounds.
    """
    base = records.withColumn("cycle", F.lit(0))
    state = settle(verify(base), "verified")
    done, index = None, None
    for n in range(1, cycles + 1):
        fails = F.coalesce(F.col("status") != "supported", F.lit(True))
        if units is not None:
            state = state.withColumn("__retry", retry_queries(F.col("failed_fields"), F.col("recovery")))
            fails = fails & (F.size("__retry") > 0)
        rest = state.where(~fails).drop("__retry")
        done = rest if done is None else done.unionByName(rest)
        again = state.where(fails)
        if again.isEmpty():
            state = None
            break
        if units is not None:
            if index is None:
                index = bm25_weights(units, "corpus", "doc", "text")
            found = retrieve_again(again, index, key, paper, "__retry", "sources")
            found = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("category", "new_ids"))).alias("new_evidence"))
            again = again.join(found, key, "left").withColumn("new_evidence", F.coalesce("new_evidence", F.create_map().cast("map<string,array<string>>")))
            none = F.array().cast("array<string>")
            merged = F.map_zip_with("sources", "new_evidence", lambda _, a, b: F.concat(F.coalesce(a, none), F.coalesce(b, none)))
            again = again.withColumn("sources", merged).drop("__retry")
        told = [c for c in ("status", "failed_fields", "recovery", "notes") if c in again.columns]
        fresh = redo(again.drop(*told)).drop("new_evidence")
        state = settle(verify(fresh.withColumn("cycle", F.lit(n))), "verified")
    out = state if done is None else done if state is None else done.unionByName(state)
    if "label" in out.columns:
        lost = F.coalesce(F.col("status") != "supported", F.lit(True))
        if "failed_fields" in out.columns:
            lost = lost & F.array_contains("failed_fields", "dimensionality_label") & (F.col("label") != "Unknown")
            out = out.withColumn("review_reason", F.when(lost, F.concat(F.lit("unresolved after verification: "), F.coalesce("notes", F.lit("None")))))
        out = out.withColumn("label", F.when(lost, "Unknown").otherwise(F.col("label")))
    return out

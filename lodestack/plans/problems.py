"""Queries of the general problems (2 and 3) and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orphans import OrphanState, find_orphans, parent_rows, reference_rows
from ..operators.packed import unpack
from ..sources import table

PACKED = {"label_in_paper": "label", "formula_abbreviation_glossary": "entry"}


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value of every packed field with its position and error flag."""
    return unpack(table(spark, d, "compound_records"), "record_id", PACKED)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_values(spark, d).where("n_values > 1").select("record_id", "field_name", "pos", "packed_value")


def _orphans(spark: SparkSession, d: str) -> OrphanState:
    units, registry = table(spark, d, "document_units"), table(spark, d, "compound_registry")
    parents = parent_rows(units, "unit", "source_id", "ingested_at", "unit_id", "is_deleted").unionByName(
        parent_rows(registry, "compound", "compound_id", "created_at", "registry_row_id", "is_deleted")
    )
    comp = table(spark, d, "compound_records")
    refs = reference_rows(comp, "compound_records", "record_id", "cation_source", "unit", "updated_at")
    for df, t, i, c, target, at in [
        (comp, "compound_records", "record_id", "connectivity_source", "unit", "updated_at"),
        (comp, "compound_records", "record_id", "compound_id", "compound", "updated_at"),
        (table(spark, d, "cation_records"), "cation_records", "cation_row_id", "compound_id", "compound", "created_at"),
        (table(spark, d, "dimensionality_reasoning"), "dimensionality_reasoning", "dim_row_id", "compound_id", "compound", "created_at"),
    ]:
        refs = refs.unionByName(reference_rows(df, t, i, c, target, at))
    return find_orphans(refs, parents, CUTS)


#: The state takes the rows in as batches that end at these times.
CUTS = [datetime(2023, 1, 1)]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).open.select("table_name", "row_id", "field_name", "ref_key")


def p3_monthly(spark: SparkSession, d: str) -> DataFrame:
    """Orphans by table, field, reason and month of the citing row."""
    return _orphans(spark, d).counts("month").withColumn("period", F.date_format("period", "yyyy-MM"))


_P3_CTE = """
parents AS (
  SELECT 'unit' AS target, lower(trim(source_id, ' ' || chr(9))) AS key, ingested_at AS seen_at, unit_id AS seq, coalesce(is_deleted, false) AS deleted FROM document_units
  UNION ALL
  SELECT 'compound', lower(trim(compound_id, ' ' || chr(9))), try_cast(created_at AS TIMESTAMP), registry_row_id, coalesce(is_deleted, false) FROM compound_registry),
state AS (
  SELECT target, key, min(seen_at) AS first_at, arg_max(deleted, (coalesce(seen_at, TIMESTAMP '0001-01-01'), seq)) AS last_deleted FROM parents GROUP BY 1, 2),
refs AS (
  SELECT 'compound_records' AS table_name, record_id AS row_id, 'cation_source' AS field_name, unnest(list_distinct(cation_source)) AS ref_key, 'unit' AS target, try_cast(updated_at AS TIMESTAMP) AS ref_at FROM compound_records
  UNION ALL
  SELECT 'compound_records', record_id, 'connectivity_source', unnest(list_distinct(connectivity_source)), 'unit', try_cast(updated_at AS TIMESTAMP) FROM compound_records
  UNION ALL
  SELECT 'compound_records', record_id, 'compound_id', compound_id, 'compound', try_cast(updated_at AS TIMESTAMP) FROM compound_records
  UNION ALL
  SELECT 'cation_records', cation_row_id, 'compound_id', compound_id, 'compound', try_cast(created_at AS TIMESTAMP) FROM cation_records
  UNION ALL
  SELECT 'dimensionality_reasoning', dim_row_id, 'compound_id', compound_id, 'compound', try_cast(created_at AS TIMESTAMP) FROM dimensionality_reasoning),
orphans AS (
  SELECT r.*, CASE WHEN s.key IS NULL THEN 'missing' WHEN s.last_deleted THEN 'deleted' WHEN s.first_at > r.ref_at THEN 'late' END AS reason
  FROM refs r LEFT JOIN state s ON s.target = r.target AND s.key = lower(trim(r.ref_key, ' ' || chr(9)))
  WHERE trim(r.ref_key, ' ' || chr(9)) <> '')
"""

QUERIES = {"p2_found": p2_found, "p2_values": p2_values, "p3_found": p3_found, "p3_monthly": p3_monthly}

SQL = {
    "p3_found": f"WITH {_P3_CTE} SELECT table_name, row_id, field_name, ref_key FROM orphans WHERE reason IS NOT NULL",
    "p3_monthly": f"WITH {_P3_CTE} SELECT table_name, field_name, reason, strftime(date_trunc('month', ref_at), '%Y-%m') AS period, count(*) AS n FROM orphans WHERE reason IS NOT NULL GROUP BY ALL",
}

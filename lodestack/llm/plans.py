"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from ..sources import table
from . import bpe, level, mixing, scans, splits, vocab
from .copies import collapse_copies, copy_members
from .glyphs import canonical_values

SAME = ["compound_formula_reported", "compound_name_reported"]


#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Continuous text and clean section name of every unit."""
    fields = scans.repair_units(table(spark, d, "document_units"))
    return fields.select("unit_id", "field_name", "repaired")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    fields = scans.repair_units(table(spark, d, "document_units"))
    return fields.select("unit_id", "field_name", F.explode("defects").alias("defect"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return splits.find_groups(table(spark, d, "compound_records"), "compound_id", "paper_id", "cation_name_reported")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.broken_rule(_groups(spark, d), "compound_id", table(spark, d, "train_test_split"))


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    labels = table(spark, d, "compound_records").select("compound_id", F.col("sb_halide_dimensionality_llm").alias("label"))
    return splits.assign_splits(_groups(spark, d), "compound_id", labels, table(spark, d, "split_targets")), labels


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """A split for each compound."""
    return _split(spark, d)[0].select("compound_id", "split")


def p4_quota(spark: SparkSession, d: str) -> DataFrame:
    """How far each split, and each label in it, is from its quota."""
    assigned, labels = _split(spark, d)
    out = splits.split_report(settle(assigned, "splits"), "compound_id", labels, table(spark, d, "split_targets"))
    return out.select("split", "label", "n", "target_share", F.round("actual_share", 6).alias("actual_share"), F.round("deviation", 3).alias("deviation"))


def _p5(spark: SparkSession, d: str) -> DataFrame:
    dim = table(spark, d, "dimensionality_reasoning")
    one = dim.select("dim_row_id", F.lit("sb_oxidation_state_reported").alias("field_name"), F.lit(1).alias("pos"), F.lit("oxidation_state").alias("vocab"), F.col("sb_oxidation_state_reported").alias("value"))
    for c in ("halides_present", "halides_bonded_to_sb"):
        items = dim.select("dim_row_id", F.posexplode(c).alias("i", "value"))
        one = one.unionByName(items.select("dim_row_id", F.lit(c).alias("field_name"), (F.col("i") + 1).cast("int").alias("pos"), F.lit("halide").alias("vocab"), "value"))
    return vocab.map_values(one, table(spark, d, "reference_values"))


def p5_mapped(spark: SparkSession, d: str) -> DataFrame:
    """The entry of every value, and its distance; entry 0 and -1 where none fits."""
    return _p5(spark, d).select("dim_row_id", "field_name", "pos", "value", "entry_id", F.round("distance", 3).alias("distance"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    written = table(spark, d, "reference_values").select("vocab", F.col("entry").alias("value")).distinct()
    # an anti join that Spark broadcasts only if its side is small
    free = _p5(spark, d).join(written, ["vocab", "value"], "left_anti")
    return free.select("dim_row_id", "field_name", "pos", "entry_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = bpe.count_tokens(table(spark, d, "documents"), ["doc_id", "source"], "text", f"{TOKENIZERS}/byte_bpe_50k.json")
    return mixing.mix_report(sized, table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Uses, target and actual share of each source."""
    return _mix(spark, d)[1]


def p9_quota(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that each source gives, what its rate asks for, and the most that rounding
    may miss it by: one copy of its largest document."""
    sized, report = _mix(spark, d)
    most = sized.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    out = report.join(most, report["source"].eqNullSafe(most["source"])).select(report["source"], F.col("used_tokens"), (F.col("rate") * F.col("tokens")).alias("wanted"), F.coalesce("largest", F.lit(0)).alias("bound"))
    return out.select("source", "used_tokens", F.round("wanted", 3).alias("wanted"), "bound", (F.abs(F.col("used_tokens") - F.col("wanted")) <= F.col("bound")).alias("kept"))


def p9_copies(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used."""
    return _mix(spark, d)[0].select("doc_id", "source", "copies")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return level.read_levels(docs, table(spark, d, "doc_levels"), ["doc_id", "lang", "source", "n_chars"])


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """Reading level of every document that has text."""
    return _levels(spark, d).select("doc_id", "level_no", F.round("score", 4).alias("score"))


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters by source and level; source '*' is the whole corpus."""
    rows = _levels(spark, d).where("level_no is not null")
    by = rows.groupBy("source", "level_no").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    every = by.groupBy("level_no").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_chars").alias("n_chars")).select(F.lit("*").alias("source"), "level_no", "n_docs", "n_chars")
    return by.unionByName(every)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).where("lang = 'en' and n_chars >= 300 and level_no is not null").select("doc_id", "level_no")


def _p6(spark: SparkSession, d: str) -> DataFrame:
    return canonical_values(
        [
            (table(spark, d, "compound_records"), "record_id", "compound_formula_reported"),
            (table(spark, d, "cation_records"), "cation_row_id", "cation_formula_explicit"),
            (table(spark, d, "dimensionality_reasoning"), "dim_row_id", "sb_halide_unit_reported"),
        ]
    )


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every value in its one form."""
    return _p6(spark, d).select("field_name", "row_id", "pos", "canonical")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d).where("odd").select("field_name", "row_id").distinct()


def p7_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One record for each set of copies, with their number."""
    return collapse_copies(table(spark, d, "compound_records"), SAME, "record_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return copy_members(table(spark, d, "compound_records"), SAME, "record_id")


def _sql_key(c: str) -> str:
    return rf"lower(regexp_replace(coalesce({c}, ''), '[^\p{{L}}\p{{N}}]+', '', 'g'))"


_SQL_P7 = f"""k AS (SELECT record_id, least({_sql_key(SAME[0])}, {_sql_key(SAME[1])}) AS a, greatest({_sql_key(SAME[0])}, {_sql_key(SAME[1])}) AS b,
  compound_formula_reported AS f, compound_name_reported AS n FROM compound_records)"""


_SQL_P4 = r"""
k AS (SELECT DISTINCT compound_id AS m, 'p:' || paper_id AS key FROM compound_records WHERE trim(paper_id) <> ''
  UNION SELECT compound_id, 'n:' || lower(regexp_replace(name, '\s+', '', 'g')) FROM (SELECT compound_id, unnest(cation_name_reported) AS name FROM compound_records)
  WHERE lower(regexp_replace(name, '\s+', '', 'g')) NOT IN ('', '-', 'n/a', 'notreported')),
e AS (SELECT DISTINCT a.m AS x, b.m AS y FROM k a JOIN k b USING (key)),
r AS (SELECT x AS root, x AS m FROM e UNION SELECT r.root, e.y FROM r JOIN e ON e.x = r.m),
g AS (SELECT m, min(root) AS c FROM r GROUP BY m),
s AS (SELECT t.compound_id, t.split, g.c FROM train_test_split t JOIN g ON g.m = t.compound_id WHERE t.split IS NOT NULL)
SELECT compound_id FROM s WHERE c IN (SELECT c FROM s GROUP BY c HAVING count(DISTINCT split) > 1)"""


def queries() -> dict:
    named = [p1_found, p1_repaired, p4_found, p4_splits, p4_quota, p5_found, p5_mapped, p6_found, p6_forms, p7_found, p7_collapsed, p8_ids, p9_shares, p9_quota, p9_copies, p10_found, p10_levels, p10_profile]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict:
    return {
        "p4_found": f"WITH RECURSIVE {_SQL_P4}",
        "p7_found": f"WITH {_SQL_P7}, m AS (SELECT *, min(record_id) OVER (PARTITION BY a, b) AS first_id FROM k) SELECT first_id, record_id AS copy_id FROM m WHERE record_id <> first_id",
        "p7_collapsed": f"WITH {_SQL_P7} SELECT min(record_id) AS first_id, count(*) AS n_copies, count(DISTINCT (f, n)) AS n_spellings FROM k GROUP BY a, b",
    }

"""Queries over extracted records: validation, chemistry, assembly and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chem as C
from ..functions import text as X
from ..operators.graph import connected_components
from ..operators.metrics import keep_last
from ..operators.selection import interleave, stratified_folds
from ..session import checkpoint_root, settle
from ..sources import read_jsonl, table, write_jsonl

LABELS = ["0D", "1D", "2D", "3D", "Unknown"]


def halide_consistency(s: SparkSession, d: str) -> DataFrame:
    """Halides of the formula that are not listed as bonded, and the other way round."""
    missing, extra = C.halide_flags(F.col("compound_formula_reported"), F.col("halides_bonded_to_sb"))
    r = table(s, d, "compound_records").select("record_id", F.array_join(missing, ",").alias("missing"), F.array_join(extra, ",").alias("extra"))
    return r.where("missing <> '' or extra <> ''")


def constraint_rules(label: Column, status: Column, statuses: Column, formulas: Column) -> Column:
    """Names of the rules that a record breaks. A null label is not allowed either; a
    null status is not sufficient; the shorter of two parallel lists decides."""
    pairs = F.arrays_zip(statuses.alias("s"), formulas.alias("f"))
    bad = F.exists(F.coalesce(pairs, F.array().cast("array<struct<s:string,f:string>>")), lambda p: F.coalesce(p["s"] == "not_reported", F.lit(False)) & p["f"].isNotNull())
    rules = F.array(
        F.when(label.isNull() | ~label.isin(*LABELS), "label_unknown"),
        F.when((status.isNull() | (status != "sufficient")) & label.isNotNull() & (label != "Unknown"), "label_without_evidence"),
        F.when(bad, "formula_not_reported"),
    )
    return F.filter(rules, lambda x: x.isNotNull())


def _unchecked(s: SparkSession, d: str) -> DataFrame:
    """Records as a source without checks would give them: every seventh without status,
    every eleventh with a label that is none, every fifth with statuses that say nothing was reported."""
    i = F.col("record_id")
    return table(s, d, "compound_records").select(
        "record_id",
        F.when(i % 11 == 0, "4D").when(i % 13 == 0, F.lit(None)).otherwise(F.col("sb_halide_dimensionality_llm")).alias("label"),
        F.when(i % 7 == 0, F.lit(None)).when(i % 17 == 0, "conflicting").otherwise(F.col("dimensionality_evidence_status")).alias("status"),
        F.when(i % 5 == 0, F.transform("cation_formula_status", lambda x: F.lit("not_reported"))).otherwise(F.col("cation_formula_status")).alias("statuses"),
        F.col("cation_formula_explicit").alias("formulas"),
    )


def constraint_checks(s: SparkSession, d: str) -> DataFrame:
    r = _unchecked(s, d)
    return r.select("record_id", F.explode(constraint_rules(F.col("label"), F.col("status"), F.col("statuses"), F.col("formulas"))).alias("violation"))


def force_unknown(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "compound_records")
    return r.select("record_id", F.when(F.col("dimensionality_evidence_status") == "sufficient", F.col("sb_halide_dimensionality_llm")).otherwise("Unknown").alias("label"))


def orphan_refs(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "compound_records")
    cited = r.select("record_id", F.explode(F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("cation_source", "connectivity_source", "synthesis_source")]))).alias("source_id")).where("source_id is not null")
    return cited.join(table(s, d, "document_units").select("source_id").distinct(), "source_id", "left_anti").select("record_id", "source_id")


def parse_formula(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "compound_records").select("record_id", C.formula_counts(F.col("compound_formula_reported")).alias("p"))
    parts = f.where("p is not null").select("record_id", F.explode("p").alias("x")).groupBy("record_id", "x.element").agg(F.sum("x.count").alias("count"))
    return parts.select("record_id", "element", F.round("count", 6).alias("count"))


def smiles_atoms(s: SparkSession, d: str) -> DataFrame:
    sm = F.concat(F.expr("repeat('C', p_size % 12 + 1)"), F.lit("[N+](C)(C)"), F.when(F.col("p_size") % 2 == 0, "c1ccccc1").otherwise("CCl"))
    return table(s, d, "part").select("p_partkey", F.size(C.heavy_atoms(sm)).alias("atoms"))


def cation_multiplier(s: SparkSession, d: str) -> DataFrame:
    k = (F.col("p_partkey") % 3 + 1).cast("double")
    c, n = (F.col("p_size") % 7).cast("double"), (F.col("p_size") % 3).cast("double")
    pairs = F.array(F.struct((c * k).alias("t"), c.alias("o")), F.struct((n * k + F.when(F.col("p_size") % 5 == 0, 0.3).otherwise(0.0)).alias("t"), n.alias("o")))
    ratios = F.transform(F.filter(pairs, lambda p: (p["t"] > 0) & (p["o"] > 0)), lambda p: p["t"] / p["o"])
    return table(s, d, "part").select("p_partkey", F.round(C.multiplier(ratios), 6).alias("multiplier"))


def inorganic_fraction(s: SparkSession, d: str) -> DataFrame:
    """Halide shares and halide to metal ratio of the inorganic part of each compound,
    the first cation's formula standing for the organic part, or why there is none."""
    r = table(s, d, "compound_records").withColumn("listed", F.array_compact(F.transform("halides_bonded_to_sb", F.trim))).where(F.size("listed") > 0)
    f = r.select("record_id", "listed", C.formula_counts(F.col("compound_formula_reported")).alias("total"), C.formula_counts(F.regexp_replace(F.get("cation_formula_explicit", F.lit(0)), r"[0-9]*[+-]$", "")).alias("organic"))
    x = C.inorganic_composition(f, "total", "organic", "listed")
    return x.select("record_id", *[F.round(f"f_{h}", 6).alias(f"f_{h.lower()}") for h in C.HALIDES], F.round("x_to_m", 6).alias("x_to_m"), "mixed", "error")


def smiles_counts(s: SparkSession, d: str) -> DataFrame:
    """Heavy atoms by element of SMILES strings, some of which are none."""
    sm = F.concat(F.expr("repeat('C', p_size % 12 + 1)"), F.lit("[N+](C)(C)"), F.when(F.col("p_size") % 2 == 0, "c1ccccc1").when(F.col("p_size") % 7 == 3, "C(").otherwise("CCl"))
    c = table(s, d, "part").select("p_partkey", C.atom_counts(sm).alias("a"))
    return c.select("p_partkey", F.explode_outer("a").alias("x")).select("p_partkey", "x.element", F.col("x.count").cast("int").alias("count"))


def one_hot(s: SparkSession, d: str) -> DataFrame:
    o = F.col("sb_oxidation_state_reported")
    return table(s, d, "dimensionality_reasoning").select("dim_row_id", (o == "+3").cast("int").alias("iii"), (o == "+5").cast("int").alias("v"), o.contains("/").cast("int").alias("mixed"))


def binary_target(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "compound_records").withColumn("label", F.trim("sb_halide_dimensionality_llm")).where(F.col("label").isin("0D", "1D", "2D", "3D"))
    return r.select("record_id", (F.col("label") != "0D").cast("int").alias("target"))


def export_projection(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "compound_records")
    return r.select(F.col("paper_id").alias("Paper"), F.col("compound_id").alias("Compound"), F.col("record_id").alias("Record"), X.joined(F.col("cation_name_reported")).alias("Cations"), X.joined(F.col("halides_present")).alias("Halides"), F.col("sb_halide_dimensionality_llm").alias("Dimensionality")).orderBy("Paper", "Compound", "Record")


def array_to_columns(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "cation_records").select("cation_row_id", *[F.get("cation_name_reported", F.lit(i)).alias(f"position_{i + 1}") for i in range(3)])


def format_pairs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "cation_records").select("cation_row_id", X.formatted_pairs(F.col("cation_abbreviation_reported"), F.col("cation_formula_explicit")).alias("glossary"))


def pairs_to_map(s: SparkSession, d: str) -> DataFrame:
    """Key-value pairs of an order's lines as a map, later lines winning; then two of its values."""
    li = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    m = li.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "p"))).alias("m"))
    return m.select("l_orderkey", F.size("m").alias("n_keys"), F.try_element_at("m", F.lit(1)).alias("first"), F.try_element_at("m", F.lit(2)).alias("second"))


def scan_json_roundtrip(s: SparkSession, d: str) -> DataFrame:
    import uuid

    path = f"{checkpoint_root(s).rstrip('/')}/jsonl-{uuid.uuid4().hex}"
    write_jsonl(table(s, d, "events").select("event_id", "event_type", "value", "props"), path)
    schema = T.StructType.fromDDL("event_id long, event_type string, value double, props string")
    e = read_jsonl(s, path, schema)
    return e.select("event_id", "event_type", F.round("value", 6).alias("value"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def pivot_left_default(s: SparkSession, d: str) -> DataFrame:
    ids = table(s, d, "train_test_split").select("compound_id")
    cat = keep_last(table(s, d, "cation_records").select("compound_id", "cation_row_id", "cation_evidence_text"), ["compound_id"], ["cation_row_id"])
    dim = keep_last(table(s, d, "dimensionality_reasoning").select("compound_id", "dim_row_id", "sb_halide_connectivity_evidence_text"), ["compound_id"], ["dim_row_id"])
    out = ids.join(cat, "compound_id", "left").join(dim, "compound_id", "left")
    return out.select("compound_id", F.coalesce("cation_evidence_text", F.lit("")).alias("cation"), F.coalesce("sb_halide_connectivity_evidence_text", F.lit("")).alias("connectivity"))


def dedupe_keep_last(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "compound_registry").select("compound_id", "created_at", "registry_row_id", "compound_formula_reported", "is_deleted")
    return keep_last(r, ["compound_id"], ["created_at", "registry_row_id"])


def components(s: SparkSession, d: str) -> DataFrame:
    """Compounds that share a paper, as connected components of the bipartite graph."""
    r = table(s, d, "compound_records").select("compound_id", F.concat(F.lit("p:"), "paper_id").alias("key"))
    n = table(s, d, "compound_records").select("compound_id", F.concat(F.lit("f:"), "compound_formula_reported").alias("key"))
    return connected_components(r.unionByName(n), "compound_id", "key")


def leakage_check(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "compound_records").select("compound_id", "paper_id").distinct()
    j = r.join(table(s, d, "train_test_split").where("split is not null"), "compound_id")
    return j.groupBy("paper_id").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def two_way_anti(s: SparkSession, d: str) -> DataFrame:
    a, b = table(s, d, "compound_records").select("compound_id").distinct(), table(s, d, "train_test_split").select("compound_id").distinct()
    return a.join(b, "compound_id", "left_anti").withColumn("side", F.lit("unassigned")).unionByName(b.join(a, "compound_id", "left_anti").withColumn("side", F.lit("unknown")))


def _paper_classes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "compound_records").groupBy("paper_id").agg((F.avg((F.col("sb_halide_dimensionality_llm") != "0D").cast("double")) > 0.5).cast("int").alias("cls"))


def group_fold_assign(s: SparkSession, d: str) -> DataFrame:
    """Papers whole to 5 folds of like size and class shares."""
    r = table(s, d, "compound_records").where("paper_id is not null").select("paper_id", (F.col("sb_halide_dimensionality_llm") != "0D").cast("int").alias("y"))
    return stratified_folds(r, "paper_id", "y", 5)


def stratified_interleave(s: SparkSession, d: str) -> DataFrame:
    """Place of each paper when classes are interleaved in proportion, by hash order within a class."""
    r = interleave(_paper_classes(s, d), "cls", "paper_id")
    return r.select("paper_id", "cls", F.round("key", 9).alias("key"))


def stratified_interleave_cap(s: SparkSession, d: str) -> DataFrame:
    """The same for 40 papers in all, shared out by class, at least one a class."""
    r = interleave(_paper_classes(s, d), "cls", "paper_id", limit=40)
    return r.select("paper_id", "cls", F.round("key", 9).alias("key"))


def greedy_diverse(s: SparkSession, d: str) -> DataFrame:
    """Six varied compounds of each class: each round takes the one least like those
    taken, with a bonus for a new oxidation state, a new set of halides and a new mixed
    flag (several halides or not); ties go to the larger id. A round is one aggregation of the table; nothing but the taken rows is collected."""
    r = table(s, d, "compound_records").where("sb_halide_dimensionality_llm is not null").groupBy("compound_id").agg(
        F.max((F.col("sb_halide_dimensionality_llm") != "0D").cast("int")).alias("cls"), F.array_distinct(F.flatten(F.collect_set("halides_present"))).alias("h"), F.max(F.coalesce("sb_oxidation_state_reported", F.lit(""))).alias("o")
    )
    r = settle(r.withColumn("x", F.array_join(F.array_sort(F.array_compact("h")), "/")).withColumn("mixed", F.col("x").contains("/")), "compounds")
    taken: list = []
    for step in range(6):
        score = F.lit(1.0)
        for t in taken:
            mine = F.array(*[F.lit(x) for x in t["h"] if x is not None]).cast("array<string>")
            inter = F.size(F.array_intersect("h", mine))
            sim = F.coalesce(inter / F.nullif(F.size(F.array_union("h", mine)), F.lit(0)), F.lit(0.0))
            score = F.least(score, F.when(F.col("cls") == t["cls"], 1 - sim))  # null, for the other class, has no part
        for c in (0, 1):
            prior = [t for t in taken if t["cls"] == c]
            for name, bonus in (("o", 0.45), ("x", 0.35), ("mixed", 0.20)) if prior else ():
                score = score + F.when((F.col("cls") == c) & ~F.col(name).isin([t[name] for t in prior]), bonus).otherwise(0.0)
        left = r.where(~F.col("compound_id").isin([t["compound_id"] for t in taken])) if taken else r
        best = left.withColumn("score", score).groupBy("cls").agg(F.max(F.struct(F.round("score", 9).alias("score"), "compound_id", "h", "o", "x", "mixed")).alias("b")).select("cls", "b.*").collect()
        taken += [{**x.asDict(), "step": step + 1} for x in best]
    rows = [(t["cls"], t["step"], t["compound_id"]) for t in taken]
    return s.createDataFrame(rows, "cls int, step int, compound_id string")


def render_block(s: SparkSession, d: str) -> DataFrame:
    num = lambda c, f: F.coalesce(F.format_string(f, c), F.lit("unknown"))
    lines = [F.concat(F.lit("Part: "), F.coalesce("p_name", F.lit("unknown"))), F.concat(F.lit("Brand: "), F.col("p_brand")), F.concat(F.lit("Price: "), num("p_retailprice", "%.2f")), F.concat(F.lit("Size: "), F.col("p_size").cast("string"))]
    return table(s, d, "part").select("p_partkey", F.concat_ws("\n", *lines).alias("block"))


QUERIES = {f.__name__: f for f in [halide_consistency, constraint_checks, force_unknown, orphan_refs, parse_formula, smiles_atoms, smiles_counts, cation_multiplier, inorganic_fraction, one_hot, binary_target, export_projection, array_to_columns, format_pairs, pairs_to_map, scan_json_roundtrip, pivot_left_default, dedupe_keep_last, leakage_check, two_way_anti, group_fold_assign, stratified_interleave, stratified_interleave_cap, greedy_diverse, render_block]}
QUERIES["connected_components"] = components

_PARTS = r"""b AS (SELECT record_id, regexp_replace(compound_formula_reported, '[\s\[\]()]', '', 'g') AS bare FROM compound_records),
ok AS (SELECT * FROM b WHERE length(bare) > 0 AND NOT contains(lower(bare), 'x') AND NOT regexp_matches(bare, '[0-9][+-][0-9]') AND array_to_string(regexp_extract_all(bare, '([A-Z][a-z]?)([0-9]*\.?[0-9]*)'), '') = bare),
p AS (SELECT record_id, unnest(regexp_extract_all(bare, '([A-Z][a-z]?)([0-9]*\.?[0-9]*)', 1)) AS element, unnest(regexp_extract_all(bare, '([A-Z][a-z]?)([0-9]*\.?[0-9]*)', 2)) AS n FROM ok),
c AS (SELECT record_id, element, sum(CASE WHEN n IN ('', '.') THEN 1.0 ELSE CAST(n AS DOUBLE) END) AS count FROM p GROUP BY ALL)"""
_CLS = "CAST(avg(CASE WHEN sb_halide_dimensionality_llm IS NULL THEN NULL WHEN sb_halide_dimensionality_llm <> '0D' THEN 1.0 ELSE 0.0 END) > 0.5 AS INT) AS cls"

SQL = {
    "halide_consistency": """SELECT record_id, array_to_string(list_sort(list_filter(f, lambda x: NOT list_contains(b, x))), ',') AS missing, array_to_string(list_sort(list_distinct(list_filter(b, lambda x: NOT list_contains(f, x)))), ',') AS extra FROM (
      SELECT record_id, list_filter(['F', 'Cl', 'Br', 'I'], lambda h: contains(coalesce(compound_formula_reported, ''), h)) AS f, list_filter(coalesce(halides_bonded_to_sb, []), lambda x: x IS NOT NULL) AS b FROM compound_records) WHERE missing <> '' OR extra <> ''""",
    "constraint_checks": """WITH u AS (SELECT record_id, CASE WHEN record_id % 11 = 0 THEN '4D' WHEN record_id % 13 = 0 THEN NULL ELSE sb_halide_dimensionality_llm END AS label,
      CASE WHEN record_id % 7 = 0 THEN NULL WHEN record_id % 17 = 0 THEN 'conflicting' ELSE dimensionality_evidence_status END AS status, cation_formula_status AS st, cation_formula_explicit AS fo FROM compound_records)
      SELECT record_id, 'label_without_evidence' AS violation FROM u WHERE coalesce(status, '') <> 'sufficient' AND label <> 'Unknown'
      UNION ALL SELECT record_id, 'label_unknown' FROM u WHERE label IS NULL OR label NOT IN ('0D', '1D', '2D', '3D', 'Unknown')
      UNION ALL SELECT DISTINCT record_id, 'formula_not_reported' FROM (SELECT record_id, CASE WHEN record_id % 5 = 0 THEN 'not_reported' ELSE x END AS x, f FROM (SELECT record_id, unnest(st) AS x, unnest(fo) AS f, unnest(range(greatest(len(st), len(fo)))) AS i, len(st) AS n FROM u) WHERE i < n) WHERE x = 'not_reported' AND f IS NOT NULL""",
    "force_unknown": "SELECT record_id, CASE WHEN dimensionality_evidence_status = 'sufficient' THEN sb_halide_dimensionality_llm ELSE 'Unknown' END AS label FROM compound_records",
    "orphan_refs": """SELECT DISTINCT record_id, source_id FROM (SELECT record_id, unnest(cation_source) AS source_id FROM compound_records UNION ALL SELECT record_id, unnest(connectivity_source) FROM compound_records UNION ALL SELECT record_id, unnest(synthesis_source) FROM compound_records)
      WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM document_units)""",
    "parse_formula": f"WITH {_PARTS} SELECT record_id, element, round(count, 6) AS count FROM c",
    "smiles_atoms": r"SELECT p_partkey, CAST(len(regexp_extract_all(repeat('C', p_size % 12 + 1) || '[N+](C)(C)' || CASE WHEN p_size % 2 = 0 THEN 'c1ccccc1' ELSE 'CCl' END, '(\[[^\]]+\]|Cl|Br|[BCNOPSFI]|[bcnops])')) AS INT) AS atoms FROM part",
    "cation_multiplier": """WITH r AS (SELECT p_partkey, list_filter([CASE WHEN c > 0 THEN c * k / c END, CASE WHEN n > 0 THEN (n * k + e) / n END], lambda x: x IS NOT NULL) AS r FROM (
      SELECT p_partkey, CAST(p_partkey % 3 + 1 AS DOUBLE) AS k, CAST(p_size % 7 AS DOUBLE) AS c, CAST(p_size % 3 AS DOUBLE) AS n, CASE WHEN p_size % 5 = 0 THEN 0.3 ELSE 0.0 END AS e FROM part)),
      m AS (SELECT p_partkey, r, list_transform(list_filter(r, lambda x: abs(x - round_even(x, 0)) < 0.08), lambda x: round_even(x, 0)) AS near FROM r)
      SELECT p_partkey, round(CASE WHEN len(r) = 0 THEN 1.0 WHEN len(near) > 0 THEN list_median(near) ELSE list_median(r) END, 6) AS multiplier FROM m""".replace("list_median(near)", "list_aggregate(near, 'median')").replace("list_median(r)", "list_aggregate(r, 'median')"),
    "inorganic_fraction": r"""WITH r AS (SELECT record_id, list_filter(list_transform(halides_bonded_to_sb, lambda x: trim(x)), lambda x: x IS NOT NULL) AS listed, regexp_replace(compound_formula_reported, '[\s\[\]()]', '', 'g') AS t,
        regexp_replace(regexp_replace(cation_formula_explicit[1], '[0-9]*[+-]$', ''), '[\s\[\]()]', '', 'g') AS o FROM compound_records),
      b AS (SELECT * FROM r WHERE len(listed) > 0),
      e AS (SELECT record_id, 't' AS side, t AS f FROM b UNION ALL SELECT record_id, 'o', o FROM b),
      g AS (SELECT * FROM e WHERE length(f) > 0 AND NOT contains(lower(f), 'x') AND NOT regexp_matches(f, '[0-9][+-][0-9]') AND array_to_string(regexp_extract_all(f, '([A-Z][a-z]?)([0-9]*\.?[0-9]*)'), '') = f),
      p AS (SELECT record_id, side, unnest(regexp_extract_all(f, '([A-Z][a-z]?)([0-9]*\.?[0-9]*)', 1)) AS el, unnest(regexp_extract_all(f, '([A-Z][a-z]?)([0-9]*\.?[0-9]*)', 2)) AS n FROM g),
      c AS (SELECT record_id, side, el, sum(CASE WHEN n IN ('', '.') THEN 1.0 ELSE CAST(n AS DOUBLE) END) AS k FROM p GROUP BY ALL),
      q AS (SELECT list(CASE WHEN abs(v - round_even(v, 0)) < 0.08 THEN round_even(v, 0) END) AS near, list(v) AS v, record_id FROM (SELECT a.record_id, a.k / z.k AS v FROM c a JOIN c z ON a.record_id = z.record_id AND a.el = z.el AND a.side = 't' AND z.side = 'o' WHERE a.el IN ('C', 'N', 'S', 'P') AND a.k > 0 AND z.k > 0) GROUP BY record_id),
      m AS (SELECT b.record_id, listed, b.record_id IN (SELECT record_id FROM g WHERE side = 't') AS fixed, coalesce(list_aggregate(list_filter(near, lambda x: x IS NOT NULL), 'median'), list_aggregate(v, 'median'), 1.0) AS mult FROM b LEFT JOIN q USING (record_id)),
      h AS (SELECT m.record_id, x.el, list_contains(listed, x.el) AS own, coalesce(ct.k, 0) - mult * coalesce(co.k, 0) AS rest FROM m, (SELECT unnest(['F', 'Cl', 'Br', 'I']) AS el) x LEFT JOIN c ct ON ct.record_id = m.record_id AND ct.side = 't' AND ct.el = x.el LEFT JOIN c co ON co.record_id = m.record_id AND co.side = 'o' AND co.el = x.el),
      s AS (SELECT record_id, sum(CASE WHEN own THEN greatest(rest, 0) ELSE 0 END) AS total, bool_or(NOT own AND rest > 0.08) AS stray, max(CASE WHEN el = 'F' AND own THEN greatest(rest, 0) ELSE 0 END) AS f, max(CASE WHEN el = 'Cl' AND own THEN greatest(rest, 0) ELSE 0 END) AS cl, max(CASE WHEN el = 'Br' AND own THEN greatest(rest, 0) ELSE 0 END) AS br, max(CASE WHEN el = 'I' AND own THEN greatest(rest, 0) ELSE 0 END) AS i FROM h GROUP BY 1),
      w AS (SELECT record_id, sum(k) AS metal FROM c WHERE side = 't' AND el IN ('Sb', 'Bi') GROUP BY 1),
      z AS (SELECT m.record_id, len(listed) > 1 AS mixed, listed, total, metal, f, cl, br, i, CASE WHEN len(list_filter(listed, lambda x: x NOT IN ('F', 'Cl', 'Br', 'I'))) > 0 THEN 'unsupported_halide' WHEN len(listed) > 1 AND NOT fixed THEN 'variable_formula' WHEN len(listed) > 1 AND total <= 0 THEN 'no_inorganic_halide' WHEN len(listed) > 1 AND stray THEN 'unexplained_halide' END AS error, fixed
        FROM m JOIN s USING (record_id) LEFT JOIN w USING (record_id))
      SELECT record_id, CASE WHEN error IS NULL THEN round(CASE WHEN mixed THEN f / total ELSE CAST(list_contains(listed, 'F') AS DOUBLE) END, 6) END AS f_f, CASE WHEN error IS NULL THEN round(CASE WHEN mixed THEN cl / total ELSE CAST(list_contains(listed, 'Cl') AS DOUBLE) END, 6) END AS f_cl, CASE WHEN error IS NULL THEN round(CASE WHEN mixed THEN br / total ELSE CAST(list_contains(listed, 'Br') AS DOUBLE) END, 6) END AS f_br, CASE WHEN error IS NULL THEN round(CASE WHEN mixed THEN i / total ELSE CAST(list_contains(listed, 'I') AS DOUBLE) END, 6) END AS f_i,
        CASE WHEN error IS NULL AND total > 0 AND fixed THEN round(total / nullif(metal, 0), 6) END AS x_to_m, CASE WHEN error IS NULL THEN mixed END AS mixed, error FROM z""",
    "smiles_counts": r"""WITH x AS (SELECT p_partkey, repeat('C', p_size % 12 + 1) || '[N+](C)(C)' || CASE WHEN p_size % 2 = 0 THEN 'c1ccccc1' WHEN p_size % 7 = 3 THEN 'C(' ELSE 'CCl' END AS sm, p_size % 2 <> 0 AND p_size % 7 = 3 AS bad FROM part),
      a AS (SELECT p_partkey, unnest(regexp_extract_all(sm, '(\[[^\]]+\]|Cl|Br|[BCNOPSFI]|[bcnops])')) AS t FROM x WHERE NOT bad)
      SELECT p_partkey, CASE WHEN t = '[N+]' THEN 'N' WHEN t = 'c' THEN 'C' ELSE t END AS element, CAST(count(*) AS INT) AS count FROM a GROUP BY 1, 2 UNION ALL SELECT p_partkey, NULL, NULL FROM x WHERE bad""",
    "one_hot": "SELECT dim_row_id, CAST(sb_oxidation_state_reported = '+3' AS INT) AS iii, CAST(sb_oxidation_state_reported = '+5' AS INT) AS v, CAST(contains(sb_oxidation_state_reported, '/') AS INT) AS mixed FROM dimensionality_reasoning",
    "binary_target": "SELECT record_id, CAST(trim(sb_halide_dimensionality_llm) <> '0D' AS INT) AS target FROM compound_records WHERE trim(sb_halide_dimensionality_llm) IN ('0D', '1D', '2D', '3D')",
    "export_projection": """SELECT paper_id AS "Paper", compound_id AS "Compound", record_id AS "Record", CASE WHEN cation_name_reported IS NOT NULL THEN coalesce(array_to_string(cation_name_reported, '; '), '') END AS "Cations", CASE WHEN halides_present IS NOT NULL THEN coalesce(array_to_string(halides_present, '; '), '') END AS "Halides", sb_halide_dimensionality_llm AS "Dimensionality" FROM compound_records""",
    "array_to_columns": "SELECT cation_row_id, cation_name_reported[1] AS position_1, cation_name_reported[2] AS position_2, cation_name_reported[3] AS position_3 FROM cation_records",
    "format_pairs": """SELECT cation_row_id, g AS glossary FROM cation_records LEFT JOIN (SELECT cation_row_id, string_agg(s || ' = ' || coalesce(f, '[NOT DEFINED IN EVIDENCE]'), '; ' ORDER BY i) AS g FROM (
      SELECT cation_row_id, unnest(cation_abbreviation_reported) AS s, unnest(cation_formula_explicit) AS f, unnest(range(len(cation_abbreviation_reported))) AS i FROM cation_records) WHERE s IS NOT NULL GROUP BY 1) USING (cation_row_id)""",
    "pairs_to_map": """WITH l AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p FROM lineitem GROUP BY ALL)
      SELECT l_orderkey, CAST(count(*) AS INT) AS n_keys, max(CASE WHEN l_linenumber = 1 THEN p END) AS first, max(CASE WHEN l_linenumber = 2 THEN p END) AS second FROM l GROUP BY 1""",
    "scan_json_roundtrip": "SELECT event_id, event_type, round(value, 6) AS value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "pivot_left_default": """SELECT compound_id, coalesce(c, '') AS cation, coalesce(x, '') AS connectivity FROM train_test_split
      LEFT JOIN (SELECT compound_id, list(cation_evidence_text ORDER BY cation_row_id DESC)[1] AS c FROM cation_records GROUP BY 1) USING (compound_id) LEFT JOIN (SELECT compound_id, list(sb_halide_connectivity_evidence_text ORDER BY dim_row_id DESC)[1] AS x FROM dimensionality_reasoning GROUP BY 1) USING (compound_id)""",
    "dedupe_keep_last": "SELECT compound_id, created_at, registry_row_id, compound_formula_reported, is_deleted FROM (SELECT *, row_number() OVER (PARTITION BY compound_id ORDER BY created_at DESC, registry_row_id DESC) AS r FROM compound_registry) WHERE r = 1",
    "connected_components": """WITH RECURSIVE k AS (SELECT DISTINCT compound_id AS m, 'p:' || paper_id AS key FROM compound_records WHERE paper_id IS NOT NULL UNION SELECT compound_id, 'f:' || compound_formula_reported FROM compound_records WHERE compound_formula_reported IS NOT NULL),
      e AS (SELECT DISTINCT a.m AS x, b.m AS y FROM k a JOIN k b USING (key)), r AS (SELECT x AS root, x AS m FROM e UNION SELECT r.root, e.y FROM r JOIN e ON e.x = r.m) SELECT m AS compound_id, min(root) AS component FROM r GROUP BY 1""",
    "leakage_check": "SELECT paper_id, count(DISTINCT split) AS n_splits FROM (SELECT DISTINCT compound_id, paper_id FROM compound_records) JOIN train_test_split USING (compound_id) WHERE split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "two_way_anti": "SELECT DISTINCT compound_id, 'unassigned' AS side FROM compound_records WHERE compound_id NOT IN (SELECT compound_id FROM train_test_split) UNION ALL SELECT DISTINCT compound_id, 'unknown' FROM train_test_split WHERE compound_id NOT IN (SELECT compound_id FROM compound_records)",
    "stratified_interleave": f"WITH g AS (SELECT paper_id, {_CLS} FROM compound_records GROUP BY 1) SELECT paper_id, cls, round((row_number() OVER (PARTITION BY cls ORDER BY md5(paper_id), paper_id) - 0.5) / count(*) OVER (PARTITION BY cls), 9) AS key FROM g",
    "stratified_interleave_cap": f"WITH g AS (SELECT paper_id, {_CLS} FROM compound_records GROUP BY 1), n AS (SELECT cls, greatest(1, CAST(round_even(40 * count(*) / (SELECT count(*) FROM g), 0) AS BIGINT)) AS m, count(*) AS c FROM g GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5(paper_id), paper_id) AS k FROM g) SELECT paper_id, r.cls, round((k - 0.5) / least(m, c), 9) AS key FROM r JOIN n ON r.cls IS NOT DISTINCT FROM n.cls WHERE k <= m",
    "render_block": """SELECT p_partkey, 'Part: ' || coalesce(p_name, 'unknown') || chr(10) || 'Brand: ' || p_brand || chr(10) || 'Price: ' || coalesce(printf('%.2f', p_retailprice), 'unknown') || chr(10) || 'Size: ' || p_size AS block FROM part""",
}

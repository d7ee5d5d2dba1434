"""Queries of record assembly, flags, export, layout and prompts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assembly as A
from ..operators.metrics import keep_last
from ..operators.skew import ranked
from ..sources import table


def export_final(s: SparkSession, d: str) -> DataFrame:
    """The final table, by paper and compound in the order of their strings."""
    r = A.final_table(table(s, d, "compound_records"), keep=["record_id"])
    return r.orderBy("paper_id", "compound_id", "record_id")


def export_lines(s: SparkSession, d: str) -> DataFrame:
    """Each final record as a JSON object, lists kept as lists, nulls kept."""
    r = A.final_table(table(s, d, "compound_records"), joined=False, keep=["record_id"])
    cols = ["paper_id", "compound_id", "label_in_paper", "cation_name_reported", "halides_present", "sb_halide_dimensionality", "retrieval_cycles_used"]
    return r.select("record_id", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("line"))


def automatic_flags(s: SparkSession, d: str) -> DataFrame:
    """Every flag of every record with its place."""
    r = table(s, d, "compound_records")
    # as a source with lost characters would give them
    name = F.regexp_replace("compound_name_reported", "^[α-ω]-", "[?]-")
    flags = A.automatic_flags(name, F.col("compound_formula_reported"), F.col("cation_formula_explicit"), F.col("sb_halide_unit_reported"), F.col("halides_bonded_to_sb"))
    return r.select("record_id", F.posexplode(flags).alias("pos", "flag"))


def source_messages(s: SparkSession, d: str) -> DataFrame:
    """Messages on cited units that don't exist and compounds that the registry lacks."""
    r = table(s, d, "compound_records")
    none = F.array().cast("array<string>")
    cited = r.select("record_id", "compound_id", F.explode(F.array_distinct(F.concat(*[F.coalesce(c, none) for c in ("cation_source", "connectivity_source", "synthesis_source")]))).alias("source_id")).where("source_id is not null")
    gone = cited.join(table(s, d, "document_units").select("source_id").distinct(), "source_id", "left_anti")
    a = gone.select("record_id", F.concat("compound_id", F.lit(": cited source_id '"), "source_id", F.lit("' not found in chunk index")).alias("message"))
    lacking = r.join(table(s, d, "compound_registry").select("compound_id").distinct(), "compound_id", "left_anti")
    return a.unionByName(lacking.select("record_id", F.concat("compound_id", F.lit(": not present in compound registry")).alias("message")))


def assembled(s: SparkSession, d: str) -> DataFrame:
    cat = table(s, d, "cation_records")
    last = keep_last(cat.select("compound_id", "cation_abbreviation_reported", "cation_formula_explicit", "cation_row_id").where("compound_id is not null"), ["compound_id"], ["cation_row_id"])
    glossary = last.select("compound_id", F.col("cation_abbreviation_reported").alias("symbols"), F.col("cation_formula_explicit").alias("definitions"))
    return A.assemble_records(table(s, d, "compound_registry"), cat, table(s, d, "dimensionality_reasoning"), glossary=glossary)


def assemble_record(s: SparkSession, d: str) -> DataFrame:
    """A flat record of each registered compound; lists as strings, so that they compare as text."""
    r = assembled(s, d)
    lists = {f.name for f in r.schema.fields if f.dataType.typeName() == "array"}
    return r.select(*[F.array_join(c, "|", "-").alias(c) if c in lists else F.col(c) for c in r.columns])


def reading_order(s: SparkSession, d: str) -> DataFrame:
    """Place of each unit in its paper, from 0: by page, table rows first, then blocks from
    the top and from the left (to a tenth), then by id."""
    u = table(s, d, "document_units")
    block, y, x = (F.col("unit_type") != "table_row").cast("int"), F.bround(F.get("bbox", F.lit(1)), 1), F.bround(F.get("bbox", F.lit(0)), 1)
    u = u.select("unit_id", "paper_id", "page", block.alias("block"), y.alias("y"), x.alias("x"))
    r = ranked(u, ["paper_id"], ["page", "block", F.asc_nulls_first("y"), F.asc_nulls_first("x"), "unit_id"], F.col("page"), "n")
    return r.select("unit_id", (F.col("n") - 1).alias("place"))


def grouped_lists(s: SparkSession, d: str) -> DataFrame:
    """Units of each page of a paper as a list in reading order: a page is bounded, a paper is not."""
    u = table(s, d, "document_units").select("paper_id", "page", "order_index", "unit_id")
    g = u.groupBy("paper_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "unit_id"))), lambda x: x["unit_id"].cast("string")).alias("ids"))
    return g.select("paper_id", "page", F.size("ids").alias("n_units"), F.array_join("ids", ",").alias("unit_ids"))


def paper_discovery(s: SparkSession, d: str) -> DataFrame:
    """The file of each paper: the id is in its name, the shortest name wins, then the first."""
    # names as a folder of documents would have them
    n = table(s, d, "document_units").select(F.concat(F.lower("paper_id"), F.lit("_"), "doc_type", F.when(F.col("page") % 3 == 0, F.lit("_v2")).otherwise(""), F.lit(".pdf")).alias("name")).distinct()
    f = n.select(F.upper(F.regexp_extract("name", r"([Pp]\d{3,5})", 1)).alias("paper_id"), "name").where("paper_id <> ''")
    return f.groupBy("paper_id").agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("name"))


def section_of_rows(s: SparkSession, d: str) -> DataFrame:
    """Units that a box of their page's table rows or captions overlaps: touching edges don't count."""
    u = table(s, d, "document_units").where("bbox is not null").select("unit_id", "paper_id", "page", "unit_type", *[F.col("bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])
    a, b = u.where("unit_type = 'paragraph'"), u.where("unit_type <> 'paragraph'").select("paper_id", "page", *[F.col(c).alias("t" + c) for c in ("x0", "y0", "x1", "y1")])
    over = a.join(b, ["paper_id", "page"]).where("x0 < tx1 and x1 > tx0 and y0 < ty1 and y1 > ty0")
    return over.select("unit_id").distinct()


def nested_sanitize(s: SparkSession, d: str) -> DataFrame:
    """Every text of a nested record repaired: strings, lists and lists of pairs alike."""
    r = table(s, d, "compound_records")
    dirty = lambda c: F.replace(F.replace(c, F.lit("·"), F.lit("\x7f")), F.lit("+"), F.lit("\x05"))
    rec = r.select("record_id", F.struct(dirty(F.col("compound_formula_reported")).alias("formula"), F.transform("cation_formula_explicit", dirty).alias("cations"), F.struct(dirty(F.col("sb_halide_unit_reported")).alias("unit")).alias("inner")).alias("rec"))
    fixed = rec.select("record_id", X.sanitized(F.col("rec"), rec.schema["rec"].dataType).alias("rec"))
    return fixed.select("record_id", "rec.formula", F.array_join("rec.cations", "|", "-").alias("cations"), F.col("rec.inner.unit").alias("unit"))


def canonical_hash(s: SparkSession, d: str) -> DataFrame:
    """First 16 hex digits of SHA-256 over sorted-key JSON of a record."""
    j = X.canonical_json({"segment": F.col("c_mktsegment"), "name": F.col("c_name"), "nation": F.col("c_nationkey"), "none": F.lit(None).cast("string")})
    return table(s, d, "customer").select("c_custkey", F.substring(F.sha2(j, 256), 1, 16).alias("hash"))


def example_hashes(s: SparkSession, d: str) -> DataFrame:
    """SHA-256 of each example's text."""
    return table(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"))


def running_ids(s: SparkSession, d: str) -> DataFrame:
    """New compounds numbered in the order of their ids, at least two digits."""
    r = ranked(table(s, d, "compound_registry").select("registry_row_id"), [], ["registry_row_id"], F.floor(F.col("registry_row_id") / 1000), "n")
    return r.select("registry_row_id", F.format_string("NEW_%02d", "n").alias("made_id"))


def distinct_cations(s: SparkSession, d: str) -> DataFrame:
    """Distinct pairs of cation name and formula, those with a null left out."""
    c = table(s, d, "cation_records").select(F.explode(F.arrays_zip("cation_name_reported", "cation_formula_explicit")).alias("p"))
    return c.select(F.col("p.cation_name_reported").alias("name"), F.col("p.cation_formula_explicit").alias("formula")).dropna().distinct()


def absolute_limit(s: SparkSession, d: str) -> DataFrame:
    """Greatest absolute difference by group, 1 where all are 0."""
    li = table(s, d, "lineitem").groupBy("l_returnflag").agg(F.max(F.abs(F.col("l_discount") - F.col("l_tax"))).alias("m"))
    return li.select("l_returnflag", F.round(F.when(F.col("m") == 0, 1.0).otherwise(F.col("m")), 6).alias("limit"))


def enum_filter_report(s: SparkSession, d: str) -> DataFrame:
    """Rows kept and dropped by the filter on the trimmed label."""
    r = table(s, d, "compound_records").select(F.trim("sb_halide_dimensionality_llm").isin("0D", "1D", "2D", "3D").alias("ok"))
    return r.agg(F.count_if(F.col("ok")).alias("kept"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("dropped"))


def class_labels(s: SparkSession, d: str) -> DataFrame:
    """Labels with a sign and by class: 0D or non-0D; a number gets a plus before it."""
    r = table(s, d, "compound_records").where("sb_halide_dimensionality_llm in ('0D', '1D', '2D', '3D')")
    return r.select("record_id", F.when(F.col("sb_halide_dimensionality_llm") == "0D", "0D").otherwise("non-0D").alias("shot_class"), X.signed(F.col("sb_oxidation_state_reported")).alias("state"))


def stability_merge(s: SparkSession, d: str) -> DataFrame:
    """Two conditions of the same keys side by side, in the order of the keys."""
    o = table(s, d, "orders")
    side = lambda flag, n: o.where(F.col("o_orderstatus") == flag).groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias(n))
    j = A.one_to_one(side("F", "a"), side("O", "b"), ["o_orderpriority"])
    return j.select("o_orderpriority", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.round(F.col("b") - F.col("a"), 4).alias("delta")).orderBy("o_orderpriority")


def keyed_concat(s: SparkSession, d: str) -> DataFrame:
    """Columns of two tables side by side by key, rows of either kept."""
    a = table(s, d, "part").select("p_partkey", "p_size")
    b = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return a.join(b, "p_partkey", "full")


def example_prompt(s: SparkSession, d: str) -> DataFrame:
    """A classification prompt for each test part: instruction, the examples in order, the
    query; parted before the query, so that the part before it is the same for all."""
    p = table(s, d, "part").withColumn("block", F.concat(F.lit("Name: "), F.col("p_name"), F.lit("\nSize: "), X.shortest_number(F.col("p_size") / 4), F.lit("\nPrice: "), F.format_string("%.4f", "p_retailprice")))
    shots = p.where("p_partkey <= 6").agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.concat("block", F.lit("\nAnswer: "), (F.col("p_size") > 25).cast("int").cast("string")).alias("b")))).alias("x"))
    shots = shots.select(F.array_join(F.transform("x", lambda y: y["b"]), "\n\n").alias("shots"))
    # the examples are a fixed number, so the one row is bounded
    full = p.where("p_partkey > 6").join(F.broadcast(shots)).select("p_partkey", A.example_prompt(F.lit("Classify the part."), F.col("shots"), F.col("block")).alias("prompt"))
    return full.select("p_partkey", F.md5(X.before_last("prompt", A.MARKER)).alias("prefix"), F.substring_index("prompt", A.MARKER, -1).alias("query"))


def ranking_prompt(s: SparkSession, d: str) -> DataFrame:
    """The prompt of each trial: definitions of the features in the order of the trial."""
    f = {f"F{i}": (f"Feature {i}", f"definition {i}") for i in range(1, 8)}
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("trial"), F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.concat(F.lit("F"), F.pmod(i * (F.col("o_orderkey") % 6 + 1) + F.col("o_orderkey"), F.lit(7)).cast("int").cast("string"))).alias("o"))
    o = o.withColumn("o", F.transform("o", lambda x: F.when(x == "F0", "F7").otherwise(x)))
    prompt, error = A.ranking_prompt(F.col("o"), f, "Rank.\n\n", "\n\nAnswer in JSON.", F.when(F.col("trial") % 2 == 0, "with_data").otherwise("no_data"), F.when(F.col("trial") % 4 == 0, "examples"))
    return o.select("trial", F.md5(prompt).alias("hash"), F.length(prompt).alias("n"), error.alias("error"))


QUERIES = {f.__name__: f for f in [export_final, export_lines, automatic_flags, source_messages, assemble_record, reading_order, grouped_lists, paper_discovery, section_of_rows, nested_sanitize, canonical_hash, example_hashes, running_ids, distinct_cations, absolute_limit, enum_filter_report, class_labels, stability_merge, keyed_concat, example_prompt, ranking_prompt]}

_J = "CASE WHEN {0} IS NOT NULL THEN coalesce(array_to_string({0}, '; '), '') END AS {0}"
_LISTS = "cation_name_reported cation_abbreviation_reported cation_formula_explicit cation_formula_status cation_source halides_present halides_bonded_to_sb connectivity_source synthesis_source automatic_flags".split()
_PLAIN = "label_in_paper, compound_name_reported, compound_formula_reported, formula_abbreviation_glossary, cation_evidence_text, sb_oxidation_state_reported, sb_halide_unit_reported, sb_halide_connectivity_evidence_text, sb_halide_dimensionality_llm AS sb_halide_dimensionality, dimensionality_reasoning, dimensionality_evidence_status, dimensionality_review_reason, synthesis_target_compound, synthesis_evidence_text, verification_status, verification_notes, retrieval_cycles_used"
_P = "array_to_string(list_transform(coalesce({0}, []), lambda x: coalesce(x, '{1}')), '|') AS {0}"
# the same fixed values, written out for the SQL
_OK = "·°±→↔≡′″ÅåΔδαβγμωΩ–—…‹›⋯×−⁻⁺⁰¹²³⁴⁵⁶⁷⁸⁹"

SQL = {
    "export_final": f"SELECT record_id, paper_id, compound_id, {_PLAIN}, {', '.join(_J.format(c) for c in _LISTS)} FROM compound_records",
    "export_lines": """SELECT record_id, CAST(to_json({'paper_id': paper_id, 'compound_id': compound_id, 'label_in_paper': label_in_paper, 'cation_name_reported': cation_name_reported, 'halides_present': halides_present, 'sb_halide_dimensionality': sb_halide_dimensionality_llm, 'retrieval_cycles_used': retrieval_cycles_used}) AS VARCHAR) AS line FROM compound_records""",
    "automatic_flags": rf"""WITH t AS (SELECT record_id, 1 AS k, 0 AS i, 'compound_name_reported' AS label, regexp_replace(compound_name_reported, '^[α-ω]-', '[?]-') AS v FROM compound_records
      UNION ALL SELECT record_id, 2, 0, 'compound_formula_reported', compound_formula_reported FROM compound_records
      UNION ALL SELECT record_id, 3, i, 'cation_formula_explicit[' || i || ']', v FROM (SELECT record_id, unnest(cation_formula_explicit) AS v, unnest(range(len(cation_formula_explicit))) AS i FROM compound_records)
      UNION ALL SELECT record_id, 4, 0, 'sb_halide_unit_reported', sb_halide_unit_reported FROM compound_records),
      o AS (SELECT record_id, k, i, label, ch, min(p) AS p FROM (SELECT record_id, k, i, label, unnest(o) AS ch, unnest(range(len(o))) AS p FROM (SELECT *, regexp_extract_all(v, '[^\x20-\x7E\n\t{_OK}]') AS o FROM t)) GROUP BY ALL),
      s AS (SELECT record_id, k, i, label, list(printf('U+%04X ''%s''', unicode(ch), ch) ORDER BY p)[1:5] AS shown FROM o GROUP BY ALL),
      h AS (SELECT record_id, coalesce(compound_formula_reported, '') AS fo, list_filter(['Br', 'Cl', 'F', 'I'], lambda h: contains(coalesce(compound_formula_reported, ''), h)) AS f, list_sort(list_distinct(list_filter(coalesce(halides_bonded_to_sb, []), lambda x: x IS NOT NULL))) AS b FROM compound_records),
      m AS (SELECT record_id, fo, list_filter(f, lambda x: NOT list_contains(b, x)) AS missing, list_filter(b, lambda x: NOT list_contains(f, x)) AS extra FROM h),
      a AS (SELECT record_id, k, i, 0 AS w, label || ': contains ''[?]'': a character was lost and masked' AS flag FROM t WHERE contains(v, '[?]')
      UNION ALL SELECT record_id, k, i, 1, label || ': unexpected character(s) ' || array_to_string(shown, ', ') FROM s
      UNION ALL SELECT record_id, 5, 0, 0, 'halide(s) [''' || array_to_string(missing, ''', ''') || '''] appear in compound_formula_reported (''' || fo || ''') but are not listed in halides_bonded_to_sb' FROM m WHERE len(missing) > 0
      UNION ALL SELECT record_id, 5, 0, 1, 'halides_bonded_to_sb lists [''' || array_to_string(extra, ''', ''') || '''], not found in compound_formula_reported (''' || fo || ''')' FROM m WHERE len(extra) > 0)
      SELECT record_id, CAST(row_number() OVER (PARTITION BY record_id ORDER BY k, i, w) - 1 AS INT) AS pos, flag FROM a""",
    "source_messages": """SELECT DISTINCT record_id, compound_id || ': cited source_id ''' || source_id || ''' not found in chunk index' AS message FROM (SELECT record_id, compound_id, unnest(cation_source) AS source_id FROM compound_records UNION ALL SELECT record_id, compound_id, unnest(connectivity_source) FROM compound_records UNION ALL SELECT record_id, compound_id, unnest(synthesis_source) FROM compound_records)
      WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM document_units WHERE source_id IS NOT NULL)
      UNION ALL SELECT record_id, compound_id || ': not present in compound registry' FROM compound_records WHERE compound_id NOT IN (SELECT compound_id FROM compound_registry WHERE compound_id IS NOT NULL)""",
    "assemble_record": f"""WITH g AS (SELECT * FROM compound_registry WHERE compound_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY compound_id ORDER BY created_at DESC NULLS LAST, registry_row_id DESC) = 1),
      c AS (SELECT * FROM cation_records QUALIFY row_number() OVER (PARTITION BY compound_id ORDER BY created_at DESC NULLS LAST, cation_row_id DESC) = 1), m AS (SELECT * FROM dimensionality_reasoning QUALIFY row_number() OVER (PARTITION BY compound_id ORDER BY created_at DESC NULLS LAST, dim_row_id DESC) = 1),
      y AS (SELECT compound_id, cation_abbreviation_reported AS a, cation_formula_explicit AS f FROM cation_records WHERE compound_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY compound_id ORDER BY cation_row_id DESC) = 1),
      z AS (SELECT compound_id, string_agg(a || ' = ' || coalesce(f, '[NOT DEFINED IN EVIDENCE]'), '; ' ORDER BY i) AS formula_abbreviation_glossary FROM (SELECT compound_id, unnest(a) AS a, unnest(f) AS f, unnest(range(len(a))) AS i FROM y) WHERE a IS NOT NULL GROUP BY 1)
      SELECT g.paper_id, g.compound_id, nullif(array_to_string(labels_in_paper, ', '), '') AS label_in_paper, compound_name_reported, compound_formula_reported, formula_abbreviation_glossary, {', '.join(_P.format(c, '-') for c in _LISTS[:3])}, {_P.format('cation_formula_status', 'not_reported')}, coalesce(cation_evidence_text, '') AS cation_evidence_text, {_P.format('cation_source', '-')},
      sb_oxidation_state_reported, {_P.format('halides_present', '-')}, {_P.format('halides_bonded_to_sb', '-')}, sb_halide_unit_reported, coalesce(sb_halide_connectivity_evidence_text, '') AS sb_halide_connectivity_evidence_text, {_P.format('connectivity_source', '-')},
      coalesce(CASE WHEN dimensionality_evidence_status = 'sufficient' THEN sb_halide_dimensionality_llm END, 'Unknown') AS sb_halide_dimensionality_llm, m.dimensionality_reasoning, coalesce(dimensionality_evidence_status, 'insufficient') AS dimensionality_evidence_status, dimensionality_review_reason,
      coalesce(nullif(compound_name_reported, ''), g.compound_id) AS synthesis_target_compound, '' AS synthesis_evidence_text, '' AS synthesis_source FROM g LEFT JOIN c ON c.compound_id = g.compound_id LEFT JOIN m ON m.compound_id = g.compound_id LEFT JOIN z ON z.compound_id = g.compound_id""",
    "reading_order": "SELECT unit_id, row_number() OVER (PARTITION BY paper_id ORDER BY page, unit_type <> 'table_row', round_even(bbox[2], 1) NULLS FIRST, round_even(bbox[1], 1) NULLS FIRST, unit_id) - 1 AS place FROM document_units",
    "grouped_lists": "SELECT paper_id, page, CAST(count(*) AS INT) AS n_units, string_agg(CAST(unit_id AS VARCHAR), ',' ORDER BY order_index, unit_id) AS unit_ids FROM document_units GROUP BY 1, 2",
    "paper_discovery": "WITH n AS (SELECT DISTINCT lower(paper_id) || '_' || doc_type || CASE WHEN page % 3 = 0 THEN '_v2' ELSE '' END || '.pdf' AS name FROM document_units), f AS (SELECT upper(regexp_extract(name, '([Pp][0-9]{3,5})', 1)) AS paper_id, name FROM n) SELECT paper_id, list(name ORDER BY length(name), name)[1] AS name FROM f WHERE paper_id <> '' GROUP BY 1",
    "section_of_rows": "SELECT DISTINCT a.unit_id FROM document_units a JOIN document_units b ON a.paper_id = b.paper_id AND a.page = b.page WHERE a.unit_type = 'paragraph' AND b.unit_type <> 'paragraph' AND a.bbox IS NOT NULL AND b.bbox IS NOT NULL AND a.bbox[1] < b.bbox[3] AND a.bbox[3] > b.bbox[1] AND a.bbox[2] < b.bbox[4] AND a.bbox[4] > b.bbox[2]",
    "nested_sanitize": "SELECT record_id, replace(compound_formula_reported, '+', '[?]') AS formula, array_to_string(list_transform(cation_formula_explicit, lambda x: coalesce(replace(x, '+', '[?]'), '-')), '|') AS cations, replace(sb_halide_unit_reported, '+', '[?]') AS unit FROM compound_records",
    "canonical_hash": """SELECT c_custkey, substr(sha256('{"name":"' || c_name || '","nation":' || c_nationkey || ',"none":null,"segment":"' || c_mktsegment || '"}'), 1, 16) AS hash FROM customer""",
    "example_hashes": "SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL",
    "running_ids": "SELECT registry_row_id, printf('NEW_%02d', row_number() OVER (ORDER BY registry_row_id)) AS made_id FROM compound_registry",
    "distinct_cations": "SELECT DISTINCT name, formula FROM (SELECT unnest(cation_name_reported) AS name, unnest(cation_formula_explicit) AS formula FROM cation_records) WHERE name IS NOT NULL AND formula IS NOT NULL",
    "absolute_limit": "SELECT l_returnflag, round(CASE WHEN max(abs(l_discount - l_tax)) = 0 THEN 1 ELSE max(abs(l_discount - l_tax)) END, 6) AS limit FROM lineitem GROUP BY 1".replace("AS limit", 'AS "limit"'),
    "enum_filter_report": "SELECT count(*) FILTER (WHERE trim(sb_halide_dimensionality_llm) IN ('0D', '1D', '2D', '3D')) AS kept, count(*) FILTER (WHERE NOT coalesce(trim(sb_halide_dimensionality_llm) IN ('0D', '1D', '2D', '3D'), false)) AS dropped FROM compound_records",
    "class_labels": "SELECT record_id, CASE WHEN sb_halide_dimensionality_llm = '0D' THEN '0D' ELSE 'non-0D' END AS shot_class, CASE WHEN starts_with(sb_oxidation_state_reported, '+') THEN sb_oxidation_state_reported ELSE '+' || sb_oxidation_state_reported END AS state FROM compound_records WHERE sb_halide_dimensionality_llm IN ('0D', '1D', '2D', '3D')",
    "stability_merge": "SELECT o_orderpriority, round(a, 4) AS a, round(b, 4) AS b, round(b - a, 4) AS delta FROM (SELECT o_orderpriority, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS a, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS b FROM orders GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL",
    "keyed_concat": "SELECT p_partkey, p_size, n FROM (SELECT p_partkey, p_size FROM part) a FULL JOIN (SELECT l_partkey AS p_partkey, count(*) AS n FROM lineitem GROUP BY 1) b USING (p_partkey)",
    "example_prompt": r"""WITH p AS (SELECT p_partkey, p_size, 'Name: ' || p_name || chr(10) || 'Size: ' || regexp_replace(printf('%.2f', p_size / 4), '\.?0+$', '') || chr(10) || 'Price: ' || printf('%.4f', p_retailprice) AS block FROM part),
      s AS (SELECT string_agg(block || chr(10) || 'Answer: ' || CASE WHEN p_size > 25 THEN '1' ELSE '0' END, chr(10) || chr(10) ORDER BY p_partkey) AS shots FROM p WHERE p_partkey <= 6)
      SELECT p_partkey, md5('Classify the part.' || chr(10) || chr(10) || 'Labeled examples:' || chr(10) || shots) AS prefix, block || chr(10) || 'Answer:' AS query FROM p, s WHERE p_partkey > 6""",
    "ranking_prompt": """WITH o AS (SELECT o_orderkey AS trial, list_transform(list_transform(range(7), lambda i: (i * (o_orderkey % 6 + 1) + o_orderkey) % 7), lambda x: CASE WHEN x = 0 THEN 7 ELSE x END) AS o FROM orders),
      t AS (SELECT trial, 'Rank.' || chr(10) || chr(10) || CASE WHEN trial % 4 = 0 THEN 'examples' || chr(10) || chr(10) ELSE '' END || array_to_string(list_transform(o, lambda x: 'F' || x || '. Feature ' || x || chr(10) || 'Definition: definition ' || x), chr(10) || chr(10)) || chr(10) || chr(10) || 'Answer in JSON.' AS p, CASE WHEN trial % 4 = 2 THEN 'no data block' END AS error FROM o)
      SELECT trial, CASE WHEN error IS NULL THEN md5(p) END AS hash, CASE WHEN error IS NULL THEN CAST(length(p) AS INT) END AS n, error FROM t""",
}

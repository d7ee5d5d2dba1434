"""Queries over evidence units and documents: segmentation, reading order, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators.reading import forward_fill, neighbours
from ..operators.retrieval import MAX_ALIASES, alias_hits, bm25_terms, shingle_pairs, top_per_group
from ..operators.skew import ranked
from ..sources import table

QUERY_TERMS = ["antimony", "halide", "layers", "lone", "pair", "antimony"]
CATEGORY_TERMS = ["bridging", "terminal", "dimensionality"]
ALIAS = "square pyramids"
# Phrases that speak against a chemical bond.
COUNTER_PHRASES = ["not count as a chemical bond", "secondary interaction", "excluded from the connectivity", "too long", "non-stoichiometric"]


def _q(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def paragraph_split(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "document_units").select("unit_id", F.posexplode(X.paragraphs(F.col("text"))).alias("pos", "paragraph"))
    return u.where(F.length("paragraph") >= 20)


def classify_unit(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "document_units").select("unit_id", X.unit_kind(F.col("text")).alias("kind"))


def unit_ids(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("paper_id", "doc_type", "page", "unit_type").orderBy("order_index", "unit_id")
    u = table(s, d, "document_units").withColumn("n", F.row_number().over(w))
    return u.select("unit_id", F.format_string("%s_%s_Page%d_%s%d", "paper_id", "doc_type", "page", "unit_type", "n").alias("made_id"))


def section_fill(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "document_units").select("unit_id", "paper_id", "page", "order_index", "unit_type", "text")
    filled = forward_fill(u, "paper_id", "page", ["order_index", "unit_id"], F.when(F.col("unit_type") == "heading", F.col("text")), "filled")
    return filled.select("unit_id", "filled")


def prev_next(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "document_units").select("unit_id", "paper_id", "page", "order_index")
    return neighbours(u, "paper_id", "page", ["order_index", "unit_id"], "unit_id").select("unit_id", F.col("prev_key").alias("prev_unit"), F.col("next_key").alias("next_unit"))


def regex_filter(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "document_units").where(F.col("text").rlike(r"(?i)\bSb\b|antimon")).select("unit_id")


def tokenize_counts(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").select("lang", F.explode(X.ascii_tokens(F.col("text"))).alias("token"))
    return t.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))


def text_sanity(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "compound_records").select("record_id", X.odd_characters(F.col("compound_formula_reported")).alias("odd"))
    return r.where(F.size("odd") > 0).select("record_id", F.size("odd").alias("n_odd"), F.array_join(F.slice("odd", 1, 5), " ").alias("first_odd"))


def sanitize_text(s: SparkSession, d: str) -> DataFrame:
    raw = F.replace(F.replace("compound_formula_reported", F.lit("·"), F.lit("\x7f")), F.lit("β"), F.lit("\x03bc"))
    raw = F.replace(raw, F.lit("γ"), F.lit("\x03"))
    r = table(s, d, "compound_records").select("record_id", raw.alias("raw")).where("raw is not null")
    return r.select("record_id", X.repaired_controls(F.col("raw")).alias("fixed"), (X.repaired_controls(F.col("raw")) != F.col("raw")).alias("changed"))


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.coalesce("lang", F.lit("-")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    terms = bm25_terms(_docs(s, d), "lang", "doc_id", "text", QUERY_TERMS)
    scored = terms.groupBy("lang", "doc_id").agg(F.round(F.sum("score"), 9).alias("score")).where("score > 0")
    top = top_per_group(scored, ["lang"], [F.desc("score"), "doc_id"], 10, spread="doc_id")
    return top.select("lang", "doc_id", F.round("score", 6).alias("score"), "rank")


def _pool(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d)
    best = bm25_terms(docs, "lang", "doc_id", "text", CATEGORY_TERMS).groupBy("lang", "doc_id").agg(F.round(F.max("score"), 9).alias("score")).where("score > 0")
    hits = alias_hits(docs, ["lang", "doc_id"], "text", [ALIAS]).select("lang", "doc_id").join(best, ["lang", "doc_id"], "left_anti")
    top = best.groupBy("lang").agg(F.max("score").alias("top"))
    # of alias-only documents the later ones rank higher, so only the last of each collection can reach the pool
    last = top_per_group(hits, ["lang"], [F.desc("doc_id")], 30, spread="doc_id")
    n = hits.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    alias = last.join(n, "lang").join(top, "lang", "left").select("lang", "doc_id", (F.coalesce("top", F.lit(1.0)) + F.col("n") - F.col("rank") + 1).alias("score"), F.lit("alias").alias("origin"))
    return best.select("lang", "doc_id", "score", F.lit("bm25").alias("origin")).unionByName(alias)


def candidate_pool(s: SparkSession, d: str) -> DataFrame:
    top = top_per_group(_pool(s, d), ["lang"], [F.desc("score"), "origin", "doc_id"], 30, spread="doc_id")
    return top.select("lang", "doc_id", F.round("score", 6).alias("score"), "origin", "rank")


def neighbor_expand(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "document_units")
    hits = u.where(F.col("text").rlike("lone pair")).select(F.explode(F.array("prev_source_id", "next_source_id")).alias("source_id")).where("source_id is not null").distinct()
    return u.join(hits, "source_id", "left_semi").select("unit_id", "source_id")


def topk_hits_per_group(s: SparkSession, d: str) -> DataFrame:
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit("(anion|halide|antimon)"), 1))
    u = table(s, d, "document_units").select("paper_id", "unit_id", "order_index", n.alias("hits")).where("hits > 0")
    return top_per_group(u, ["paper_id"], [F.desc("hits"), "order_index", "unit_id"], 12, spread="unit_id").select("paper_id", "unit_id", "hits", "rank")


def counter_evidence(s: SparkSession, d: str) -> DataFrame:
    cited = table(s, d, "compound_records").select(F.explode("connectivity_source").alias("source_id")).where("source_id is not null").distinct()
    first = F.get(F.filter(F.array(*[F.lit(p) for p in COUNTER_PHRASES]), lambda p: F.lower("text").contains(p)), F.lit(0))
    u = table(s, d, "document_units").select("paper_id", "source_id", "unit_id", "order_index", first.alias("phrase")).where("phrase is not null")
    u = u.join(cited, "source_id", "left_anti")
    return top_per_group(u, ["paper_id"], ["order_index", "unit_id"], 15, spread="unit_id").select("paper_id", "unit_id", F.concat_ws(": ", "source_id", F.concat(F.lit("'"), "phrase", F.lit("'"))).alias("hit"))


def alias_match(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "reference_values").select(F.lower("full_name").alias("alias")).where("alias is not null").distinct()
    short = names.count() <= MAX_ALIASES
    return alias_hits(table(s, d, "documents").where("text is not null"), ["doc_id"], "text", [r[0] for r in names.collect()] if short else names)


def jaccard_topk(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("text is not null")
    pairs = shingle_pairs(docs, "doc_id", "text", F.col("doc_id") % 50 == 0)
    top = top_per_group(pairs.withColumn("jaccard", F.round("jaccard", 6)), ["query_id"], [F.desc("jaccard"), "match_id"], 3)
    return top.select("query_id", "match_id", "jaccard", "rank")


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id: the smallest id of the documents with the same text. Texts
    are compared by SHA-256, so that only hashes are shuffled."""
    h = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    return h.join(h.groupBy("h").agg(F.min("doc_id").alias("class_id")).hint("merge"), "h").select("doc_id", "class_id")


def jaccard_members(s: SparkSession, d: str) -> DataFrame:
    """The class of each document with text, by which rows of jaccard_topk stand for documents."""
    return _classes(table(s, d, "documents").where("text is not null"))


def jaccard_topk_docs(s: SparkSession, d: str) -> DataFrame:
    """jaccard_topk for each doc_id divisible by 50, copies included, with the class it belongs to."""
    q = jaccard_members(s, d).where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    top = jaccard_topk(s, d).withColumnRenamed("query_id", "class_id")
    return q.join(top.hint("merge"), "class_id").select("query_id", "class_id", "match_id", "jaccard", "rank")


def first_mention_ids(s: SparkSession, d: str) -> DataFrame:
    reg = table(s, d, "compound_registry").select("registry_row_id", "paper_id", "supporting_source_ids")
    u = table(s, d, "document_units").groupBy("source_id").agg(F.min("order_index").alias("o"))
    seen = reg.select("registry_row_id", F.explode("supporting_source_ids").alias("source_id")).join(u, "source_id").groupBy("registry_row_id").agg(F.min("o").alias("first_seen"))
    r = reg.join(seen, "registry_row_id", "left").withColumn("first_seen", F.coalesce("first_seen", F.lit(10**9)))
    r = ranked(r, ["paper_id"], ["first_seen", "registry_row_id"], F.col("first_seen"), "n")
    return r.select("registry_row_id", F.format_string("%s_C%d", "paper_id", "n").alias("made_id"), F.col("first_seen").cast("long").alias("first_seen"))


def pick_shortest_per_key(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "document_units").where("unit_type = 'paragraph'")
    return u.groupBy("paper_id").agg(F.min_by("unit_id", F.struct(F.length("text"), "unit_id")).alias("unit_id"), F.min(F.length("text")).alias("n"))


def bbox_anti_join(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "document_units").where("bbox is not null").select("unit_id", "paper_id", "page", "unit_type", *[F.col("bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])
    a = u.where("unit_type = 'paragraph'").alias("a")
    b = u.where("unit_type <> 'paragraph'").select("paper_id", "page", *[F.col(c).alias("t" + c) for c in ("x0", "y0", "x1", "y1")]).alias("b")
    over = F.expr("a.paper_id = b.paper_id and a.page = b.page and a.x0 < b.tx1 and a.x1 > b.tx0 and a.y0 < b.ty1 and a.y1 > b.ty0")
    return a.join(b, over, "left_anti").select("unit_id")


def content_hash(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", X.content_hash(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")).alias("hash"))


QUERIES = {f.__name__: f for f in [paragraph_split, classify_unit, unit_ids, prev_next, regex_filter, tokenize_counts, text_sanity, sanitize_text, bm25_topk, candidate_pool, neighbor_expand, topk_hits_per_group, counter_evidence, alias_match, jaccard_topk, jaccard_members, jaccard_topk_docs, first_mention_ids, pick_shortest_per_key, bbox_anti_join, content_hash]}
QUERIES["forward_fill"] = section_fill


def _bm25_sql(terms: list[str], name: str = "bm") -> str:
    return rf"""
tok AS (SELECT coalesce(lang, '-') AS lang, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9]+'), lambda x: lower(x)) AS t FROM documents),
st AS (SELECT lang, count(*) AS n, avg(len(t)) AS avgdl FROM tok GROUP BY lang),
dfr AS (SELECT lang, term, count(*) AS df FROM (SELECT lang, unnest(list_distinct(t)) AS term FROM tok) GROUP BY ALL),
idf0 AS (SELECT lang, term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM dfr JOIN st USING (lang)),
mi AS (SELECT lang, avg(idf) AS mean_idf FROM idf0 GROUP BY lang),
idf AS (SELECT lang, term, CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END AS idf FROM idf0 JOIN mi USING (lang)),
q AS (SELECT term, count(*) AS times FROM (SELECT unnest([{_q(terms)}]) AS term) GROUP BY 1),
tf AS (SELECT lang, doc_id, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM tok, q),
{name} AS (SELECT lang, doc_id, term, times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS score FROM tf JOIN idf USING (lang, term) JOIN st USING (lang) JOIN q USING (term) WHERE tf > 0)"""


# the fixed values of the allowed characters, written out for the SQL
_ODD = r"[^\x20-\x7E\n\t·°±→↔≡′″ÅåΔδαβγμωΩ–—…‹›⋯×−⁻⁺⁰¹²³⁴⁵⁶⁷⁸⁹]"
SQL = {
    "paragraph_split": r"""SELECT unit_id, CAST(pos AS INT) AS pos, paragraph FROM (
      SELECT unit_id, unnest(range(len(p))) AS pos, unnest(list_transform(p, lambda x: regexp_replace(replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), chr(10), ' '), '\s{2,}', ' ', 'g'))) AS paragraph
      FROM (SELECT unit_id, regexp_split_to_array(text, '\n\s*\n') AS p FROM document_units)) WHERE length(paragraph) >= 20""",
    "classify_unit": r"""SELECT unit_id, CASE WHEN regexp_matches(text, '^(Figure|Fig\.|FIGURE)\s*[0-9]') THEN 'figure_caption'
      WHEN length(text) < 70 AND NOT regexp_matches(text, '[.,;]$') AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) > 0
       AND length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) / length(regexp_replace(text, '[^\p{L}]', '', 'g')) > 0.5 THEN 'heading' ELSE 'paragraph' END AS kind FROM (SELECT unit_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM document_units)""",
    "unit_ids": "SELECT unit_id, paper_id || '_' || doc_type || '_Page' || page || '_' || unit_type || row_number() OVER (PARTITION BY paper_id, doc_type, page, unit_type ORDER BY order_index, unit_id) AS made_id FROM document_units",
    "forward_fill": "SELECT unit_id, last_value(CASE WHEN unit_type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY page, order_index, unit_id ROWS UNBOUNDED PRECEDING) AS filled FROM document_units",
    "prev_next": "SELECT unit_id, lag(unit_id) OVER w AS prev_unit, lead(unit_id) OVER w AS next_unit FROM document_units WINDOW w AS (PARTITION BY paper_id ORDER BY page, order_index, unit_id)",
    "regex_filter": r"SELECT unit_id FROM document_units WHERE regexp_matches(text, '(?i)\bSb\b|antimon')",
    "tokenize_counts": "SELECT lang, token, count(*) AS n FROM (SELECT lang, lower(unnest(regexp_extract_all(text, '[a-zA-Z0-9]+'))) AS token FROM documents) GROUP BY ALL",
    "text_sanity": rf"""SELECT record_id, CAST(count(*) AS INT) AS n_odd, list_aggregate(list(ch ORDER BY p)[1:5], 'string_agg', ' ') AS first_odd FROM (
      SELECT record_id, ch, min(p) AS p FROM (SELECT record_id, unnest(o) AS ch, unnest(range(len(o))) AS p FROM (SELECT record_id, regexp_extract_all(compound_formula_reported, '{_ODD}') AS o FROM compound_records)) GROUP BY 1, 2) GROUP BY 1""",
    "sanitize_text": r"""SELECT record_id, fixed, fixed <> raw AS changed FROM (SELECT record_id, raw, regexp_replace(replace(replace(raw, chr(3) || 'bc', 'μ'), chr(127), '·'), '[\x00-\x08\x0B-\x1F]', '[?]', 'g') AS fixed FROM (
      SELECT record_id, replace(replace(replace(compound_formula_reported, '·', chr(127)), 'β', chr(3) || 'bc'), 'γ', chr(3)) AS raw FROM compound_records) WHERE raw IS NOT NULL)""",
    "bm25_topk": f"""WITH {_bm25_sql(QUERY_TERMS)}, s AS (SELECT lang, doc_id, round(sum(score), 9) AS score FROM bm GROUP BY ALL)
      SELECT lang, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
    "candidate_pool": f"""WITH {_bm25_sql(CATEGORY_TERMS)}, best AS (SELECT lang, doc_id, round(max(score), 9) AS score FROM bm GROUP BY ALL HAVING max(score) > 0),
      al AS (SELECT coalesce(lang, '-') AS lang, doc_id FROM documents WHERE contains(lower(coalesce(text, '')), '{ALIAS}') AND doc_id NOT IN (SELECT doc_id FROM best)),
      mx AS (SELECT lang, max(score) AS top FROM best GROUP BY lang),
      p AS (SELECT lang, doc_id, score, 'bm25' AS origin FROM best UNION ALL SELECT al.lang, doc_id, coalesce(top, 1.0) + row_number() OVER (PARTITION BY al.lang ORDER BY doc_id), 'alias' FROM al LEFT JOIN mx ON mx.lang = al.lang)
      SELECT lang, doc_id, round(score, 6) AS score, origin, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, origin, doc_id) AS rank FROM p) WHERE rank <= 30""",
    "neighbor_expand": "WITH h AS (SELECT DISTINCT unnest([prev_source_id, next_source_id]) AS source_id FROM document_units WHERE contains(text, 'lone pair')) SELECT unit_id, source_id FROM document_units WHERE source_id IN (SELECT source_id FROM h WHERE source_id IS NOT NULL)",
    "topk_hits_per_group": """SELECT paper_id, unit_id, CAST(hits AS INT) AS hits, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY hits DESC, order_index, unit_id) AS rank FROM (
      SELECT paper_id, unit_id, order_index, len(regexp_extract_all(lower(text), '(anion|halide|antimon)')) AS hits FROM document_units) WHERE hits > 0) WHERE rank <= 12""",
    "counter_evidence": f"""WITH c AS (SELECT DISTINCT unnest(connectivity_source) AS source_id FROM compound_records),
      u AS (SELECT paper_id, source_id, unit_id, order_index, list_filter([{_q(COUNTER_PHRASES)}], lambda p: contains(lower(text), p))[1] AS phrase FROM document_units)
      SELECT paper_id, unit_id, source_id || ': ''' || phrase || '''' AS hit FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY order_index, unit_id) AS rank FROM u WHERE phrase IS NOT NULL AND source_id NOT IN (SELECT source_id FROM c WHERE source_id IS NOT NULL)) WHERE rank <= 15""",
    "alias_match": "SELECT doc_id, alias FROM documents, (SELECT DISTINCT lower(full_name) AS alias FROM reference_values WHERE length(full_name) >= 2) WHERE contains(lower(text), alias)",
    "jaccard_topk": r"""WITH c AS (SELECT text, min(doc_id) AS id, bool_or(doc_id % 50 = 0) AS q FROM documents WHERE text IS NOT NULL GROUP BY text),
      w AS (SELECT id, q, list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda x: lower(x)) AS w FROM c),
      sh AS (SELECT id, q, list_distinct(list_transform(range(greatest(len(w) - 5, 0) + 1), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS s FROM w WHERE len(w) > 0),
      f AS (SELECT id, q, len(s) AS n, unnest(s) AS h FROM sh),
      i AS (SELECT a.id AS query_id, b.id AS match_id, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM f a JOIN f b ON a.h = b.h AND a.id <> b.id WHERE a.q GROUP BY 1, 2),
      j AS (SELECT query_id, match_id, round(k / (na + nb - k), 6) AS jaccard FROM i WHERE k / (na + nb - k) >= 0.8)
      SELECT query_id, match_id, jaccard, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY jaccard DESC, match_id) AS rank FROM j) WHERE rank <= 3""",
    "first_mention_ids": """WITH u AS (SELECT source_id, min(order_index) AS o FROM document_units GROUP BY 1),
      f AS (SELECT registry_row_id, min(o) AS o FROM (SELECT registry_row_id, unnest(supporting_source_ids) AS source_id FROM compound_registry) JOIN u USING (source_id) GROUP BY 1)
      SELECT registry_row_id, paper_id || '_C' || row_number() OVER (PARTITION BY paper_id ORDER BY coalesce(o, 1000000000), registry_row_id) AS made_id, CAST(coalesce(o, 1000000000) AS BIGINT) AS first_seen FROM compound_registry LEFT JOIN f USING (registry_row_id)""",
    "pick_shortest_per_key": "SELECT paper_id, arg_min(unit_id, (length(text), unit_id)) AS unit_id, CAST(min(length(text)) AS INT) AS n FROM document_units WHERE unit_type = 'paragraph' GROUP BY 1".replace("arg_min(unit_id, (length(text), unit_id))", "list(unit_id ORDER BY length(text), unit_id)[1]"),
    "bbox_anti_join": """SELECT unit_id FROM document_units a WHERE unit_type = 'paragraph' AND bbox IS NOT NULL AND NOT EXISTS (SELECT 1 FROM document_units b WHERE b.unit_type <> 'paragraph' AND b.bbox IS NOT NULL AND a.paper_id = b.paper_id AND a.page = b.page
      AND a.bbox[1] < b.bbox[3] AND a.bbox[3] > b.bbox[1] AND a.bbox[2] < b.bbox[4] AND a.bbox[4] > b.bbox[2])""",
    "content_hash": "SELECT c_custkey, substr(sha256(concat_ws(chr(31), c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR))), 1, 16) AS hash FROM customer",
}
_MEMBERS = "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id FROM documents WHERE text IS NOT NULL"
SQL |= {
    "jaccard_members": _MEMBERS,
    "jaccard_topk_docs": f"SELECT m.doc_id AS query_id, class_id, match_id, jaccard, rank FROM ({_MEMBERS}) m JOIN ({SQL['jaccard_topk']}) t ON t.query_id = m.class_id WHERE m.doc_id % 50 = 0",
}

"""BM25 retrieval over collections, aliases, neighbours and top-k selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import ascii_tokens
from ..session import settle

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Alias lists up to this length go to the tasks as one automaton; longer ones are joined.
MAX_ALIASES = 50_000
#: Characters of an alias that the join looks for.
GRAM = 6


def bm25_weights(docs: DataFrame, corpus: str, doc: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(postings corpus, doc, dl, term, tf; weights corpus, term, idf, avgdl), both settled.

    Okapi BM25 by collection: texts are cut once, and each token is a row until the
    first partial aggregation only. A term in more than half of the documents has a
    negative weight; it gets EPSILON times the mean weight of the vocabulary instead.
    A collection is any number of rows, so nothing here is broadcast by hand.
    """
    tok = docs.select(corpus, doc, ascii_tokens(F.coalesce(text, F.lit(""))).alias("t"))
    # a document without tokens is one row of a null term, so that it counts in the mean length
    flat = tok.select(corpus, doc, F.size("t").alias("dl"), F.explode_outer("t").alias("term"))
    tf = settle(flat.groupBy(corpus, doc, "dl", "term").agg(F.count("term").alias("tf")), "postings")
    one = tf.groupBy(corpus, doc).agg(F.first("dl").alias("dl"))
    stats = one.groupBy(corpus).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = tf.where("term is not null").groupBy(corpus, "term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(stats, corpus).select(corpus, "term", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = idf.groupBy(corpus).agg(F.avg("idf").alias("mean_idf"))
    fixed = F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf"))
    return tf.where("term is not null"), settle(idf.join(mean, corpus).select(corpus, "term", "avgdl", fixed.alias("idf")), "weights")


def bm25_queries(index: tuple[DataFrame, DataFrame], queries: DataFrame, corpus: str, doc: str) -> DataFrame:
    """query, corpus, doc, score > 0 for ``queries`` (query, corpus, terms: array, repeats
    count): each query against the documents of its own collection."""
    tf, weights = index
    q = queries.select("query", corpus, F.explode("terms").alias("term")).groupBy("query", corpus, "term").agg(F.count(F.lit(1)).alias("times"))
    q = q.join(weights, [corpus, "term"])
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = tf.join(q, [corpus, "term"]).groupBy("query", corpus, doc).agg(F.round(F.sum(part * F.col("times")), 9).alias("score"))
    return scored.where("score > 0")


def bm25_terms(docs: DataFrame, corpus: str, doc: str, text: str, terms: list[str]) -> DataFrame:
    """corpus, doc, term, score for each term of one fixed query that a document holds.

    Document frequencies of the whole vocabulary are needed for the mean weight
    alone and are counted from distinct tokens with partial aggregation; document
    rows of query terms only are kept, and meet their weights by joins whose side
    of a row a collection Spark may broadcast by its size.
    """
    tok = docs.select(corpus, doc, ascii_tokens(F.coalesce(text, F.lit(""))).alias("t"))
    each = sorted(set(terms))
    # one pass: every document's length, its distinct terms, and its counts of the query's terms
    times_in = lambda w: F.size(F.filter("t", lambda x: x == w))
    tf = [times_in(w).alias(f"__tf{i}") for i, w in enumerate(each)]
    rows = settle(tok.select(corpus, doc, F.size("t").alias("dl"), F.array_distinct("t").alias("seen"), *tf), "tokens")
    stats = rows.groupBy(corpus).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = rows.select(corpus, F.explode("seen").alias("term")).groupBy(corpus, "term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(stats, corpus).select(corpus, "term", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    wanted = F.col("term").isin(each)
    fixed = lambda m: F.when(F.col("idf") < 0, EPSILON * m).otherwise(F.col("idf"))
    # a row a collection: the mean over the vocabulary, and the query's terms beside it
    query = idf.groupBy(corpus).agg(F.avg("idf").alias("mean_idf"), F.collect_list(F.when(wanted, F.struct("term", "idf"))).alias("q"), F.first("avgdl").alias("avgdl"))
    query = query.select(corpus, "mean_idf", "avgdl", F.explode("q").alias("q")).select(corpus, "avgdl", F.col("q.term").alias("term"), F.col("q.idf").alias("idf"), "mean_idf").select(corpus, "avgdl", "term", fixed(F.col("mean_idf")).alias("idf"))
    held = F.filter(F.array(*[F.struct(F.lit(w).alias("term"), F.col(f"__tf{i}").alias("tf"), F.lit(terms.count(w)).alias("times")) for i, w in enumerate(each)]), lambda x: x["tf"] > 0)
    flat = rows.select(corpus, doc, "dl", F.explode(held).alias("h")).select(corpus, doc, "dl", "h.term", "h.tf", "h.times")
    scored = flat.join(query, [corpus, "term"])
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.select(corpus, doc, "term", (part * F.col("times")).alias("score"))


def top_per_group(df: DataFrame, group: list[str], order: list, k: int, buckets: int = 64, spread: str | None = None) -> DataFrame:
    """The first k rows of each group with their rank. With ``spread``, rows are first
    cut to k within hash buckets of that column, so that a hot group is no single task."""
    if spread:
        part = Window.partitionBy(*group, F.pmod(F.xxhash64(spread), F.lit(buckets))).orderBy(*order)
        df = df.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k).drop("rank")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def alias_hits(df: DataFrame, keep: list[str], text: str, aliases: list[str] | DataFrame) -> DataFrame:
    """``keep`` and alias for each alias of two or more characters in the text, letter
    case ignored. A short list becomes one automaton that each task runs over its
    texts once. A longer one, or a table (alias), is joined: both sides meet at the
    alias's first GRAM characters (shorter aliases at all of theirs), and the match
    is checked in full, so a list of any length works."""
    if isinstance(aliases, list):
        low = sorted({a.lower() for a in aliases if a and len(a) >= 2})
        if len(low) <= MAX_ALIASES:
            return _alias_scan(df, keep, text, low)
        aliases = df.sparkSession.createDataFrame([(a,) for a in low], "alias string")
    names = aliases.select(F.lower(aliases.columns[0]).alias("alias")).where(F.length("alias") >= 2).distinct()
    names = names.withColumn("gram", F.substring("alias", 1, GRAM))
    low_text = F.lower(text)
    sizes = F.array(*[F.lit(k) for k in range(2, GRAM + 1)])
    grams = F.array_distinct(F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low_text) - k + 1, F.lit(1))), lambda i: F.substring(low_text, i, k)))))
    rows = df.select(*keep, low_text.alias("__t"), F.explode(grams).alias("gram"))
    return rows.join(names.hint("merge"), "gram").where(F.col("__t").contains(F.col("alias"))).select(*keep, "alias")


def _alias_scan(df: DataFrame, keep: list[str], text: str, low: list[str]) -> DataFrame:
    """Aho-Corasick over Arrow batches; the automaton is built once a task."""
    src = df.select(*keep, F.lower(text).alias("__t"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("alias", T.StringType())])
    if not low:
        return df.select(*keep, F.lit("").alias("alias")).limit(0)

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        book = ahocorasick.Automaton()
        for i, a in enumerate(low):
            book.add_word(a, i)
        book.make_automaton()
        for b in batches:
            at, found = [], []
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if t:
                    hit = sorted({k for _, k in book.iter(t)})
                    at += [i] * len(hit)
                    found += [low[k] for k in hit]
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in b.columns[:-1]), pa.array(found, pa.string())], names=[*keep, "alias"])

    return src.mapInArrow(run, schema)


def shingle_pairs(docs: DataFrame, doc: str, text: str, is_query, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """query_id, match_id, jaccard >= threshold between distinct texts' word shingles.

    Copies of a text are one class, named by its smallest id, which is a query if
    any of its copies is. Exact: candidates share a shingle of the rarest few of
    both, few enough that texts this similar must (prefix filter), so common
    shingles never meet.
    """
    cls = docs.groupBy(F.col(text).alias("__t")).agg(F.min(doc).alias("id"), F.max(is_query).alias("q"))
    w = ascii_tokens(F.coalesce("__t", F.lit("")))
    # bound as a lambda's variable, so that a text is cut once and not for every shingle
    grams = F.transform(F.array(w), lambda t: F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(t) - words, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice(t, i + 1, words), " ")))))
    sh = cls.select("id", "q", F.get(grams, F.lit(0)).alias("s"))
    sh = settle(sh.where("s is not null").select("id", "q", F.array_distinct("s").alias("s")), "shingles")
    freq = sh.select(F.explode("s").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    keep = F.size("s") - F.ceil(F.size("s") * F.lit(threshold)) + 1
    flat = sh.select("id", "q", F.size("s").alias("n"), keep.alias("keep"), F.explode("s").alias("h")).join(freq.hint("merge"), "h")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "h"))
    pre = flat.withColumn("r", rank).where("r <= keep").select("id", "q", "n", "h")
    a, b = pre.where("q").select(F.col("id").alias("query_id"), F.col("n").alias("na"), "h"), pre.select(F.col("id").alias("match_id"), F.col("n").alias("nb"), "h")
    cand = a.join(b, "h").where((F.col("query_id") != F.col("match_id")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))).select("query_id", "match_id").distinct()
    sets = sh.select("id", "s")
    both = cand.join(sets.select(F.col("id").alias("query_id"), F.col("s").alias("x")), "query_id").join(sets.select(F.col("id").alias("match_id"), F.col("s").alias("y")), "match_id")
    inter = F.size(F.array_intersect("x", "y"))
    jac = inter / (F.size("x") + F.size("y") - inter)
    return both.select("query_id", "match_id", jac.alias("jaccard")).where(F.col("jaccard") >= threshold)

"""Queries of jaccard_topk that are later copies of a text."""

from pyspark.sql import functions as F

from lodestack.plans import units


def test_each_query_document_has_its_rows(spark, tmp_path):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(7, text), (50, text), (100, text), (8, text + " more"), (150, "alone in the world with no like text"), (200, None)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["query_id"], r["class_id"], r["match_id"]) for r in units.jaccard_topk_docs(spark, str(tmp_path)).collect())
    assert got == [(50, 7, 8), (100, 7, 8)]
    members = {r["doc_id"]: r["class_id"] for r in units.jaccard_members(spark, str(tmp_path)).collect()}
    assert members == {7: 7, 50: 7, 100: 7, 8: 8, 150: 150}

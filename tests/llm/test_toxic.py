"""Toxic documents, also those whose prose is good, are rejected."""

from pyspark.sql import functions as F

from trellis.llm import queries


def test_toxic_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0  # in neither model
    rows = queries.op1_quality_classifier(spark, d).join(labels, "doc_id").where(held)
    english = F.col("lang") == "en"
    share = {(r["english"], r["quality"], r["toxic"]): r["share"] for r in rows.groupBy(english.alias("english"), "quality", "toxic").agg(F.avg(F.col("kept").cast("double")).alias("share")).collect()}
    assert share[True, 1, 1] < 0.05 and share[True, 1, 0] > 0.98
    assert share[False, 1, 1] < 0.9 and share[False, 1, 0] > 0.98  # toxic labels of other languages have no words of their own

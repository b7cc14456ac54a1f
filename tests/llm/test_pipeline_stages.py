"""The pipeline's stages keep to their operators' methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.compare import SMALL


def test_near_dedup_is_simhash(spark):
    """What stays are the first documents of op5's components, near copies of exact ones included."""
    import corpus_pipeline
    from tessera.llm.simhash import near_duplicates

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tail = F.concat("text", F.lit(" one more"))
    docs = docs.unionByName(docs.where("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000)).unionByName(docs.where("doc_id % 3 = 1").withColumn("doc_id", F.col("doc_id") + 2_000_000).withColumn("text", tail))
    want = {r.doc_id for r in near_duplicates(docs).where("doc_id = component_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect()} == want

"""The pipeline's stages on the smallest documents and on none."""

import corpus_pipeline
from pyspark.sql import functions as F

from treeweave.llm import neardup, substrings

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "123 456", "en", "s", 7), (None, "the and of with some words here", "en", "s", 31)], docs.schema)
    kept = docs.unionByName(odd)
    columns = kept.columns
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, DIR).persist()
        assert kept.columns == columns, name
        ids[name] = {r[0] for r in kept.select("doc_id").collect()}
        if name == "language_id":
            assert not {90001, 90002} & ids[name] and None in ids[name] and len(ids[name]) >= docs.count()
        if name == "toxicity":
            toxic = {r[0] for r in spark.read.parquet(f"{DIR}/labels.parquet").filter("toxic = 1").select("doc_id").collect()}
            assert ids[name] <= ids["language_id"] and len(ids["language_id"] - ids[name] - toxic) <= 2
        if name == "near_dedup":
            classes = neardup.near_duplicates(before).groupBy("class_id").count().count()
            assert kept.count() == classes
        if name == "substring_dedup":
            assert ids[name] == ids["near_dedup"]
            assert kept.filter(F.length("text") != F.col("n_chars")).count() == 0
            assert substrings.remove_repeats(kept).agg(F.sum("n_removed")).first()[0] <= 20
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, DIR)
    assert {r[0] for r in packed.select("doc_id").collect()} == ids["substring_dedup"]


def test_no_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        assert docs.count() == 0

"""Corpus pipeline: language ID, toxicity, near-dedup, substring dedup and packing, over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame that is written as
Parquet and read again. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeweave.llm import langid, neardup, packing, substrings, toxicity
from treeweave.llm.queries import tokenizer, toxicity_model
from treeweave.llm.shared import fresh, held_out, small_batches, staged, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter, and null texts, go."""
    small_batches(spark)
    learned = langid.training_texts(docs, ~held_out(F.col("doc_id")))
    names = fresh(docs.columns, "_lang", "_score")
    return langid.identify(docs, learned, names=names).filter(F.col(names[0]) != langid.UNDETERMINED).select(docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score as toxic."""
    small_batches(spark)
    names = fresh(docs.columns, "_score", "_predicted")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, names=names).filter(F.col(names[1]) == 0).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id."""
    small_batches(spark)
    own = fresh(docs.columns, *substrings.KEYS)
    kept = neardup.near_duplicates(docs).filter("kept").select(*(F.col(k).alias(c) for k, c in zip(substrings.KEYS, own, strict=True))).distinct()
    keyed = docs.select("*", *(x.alias(c) for c, x in zip(own, substrings.identity(F.col("text"), F.col("doc_id")), strict=True)))
    return substrings.same(keyed, kept, own, "left_semi").dropDuplicates(own).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the sentences of repeated spans; ``n_chars`` follows the text."""
    small_batches(spark)
    return substrings.remove_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 2048 ids."""
    small_batches(spark)
    return packing.pack_documents(docs, tokenizer(), 2048)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packed),
]

#: Models and tokens are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

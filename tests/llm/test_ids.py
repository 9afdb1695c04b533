"""Ids beyond 2**53 beside null ones, in one batch, through every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeweave.llm import ann, bpe, codes, html, langid, neardup, packing, quality, substrings, topk, toxicity, urls
from treeweave.llm.queries import tokenizer

IDS = [2**53 + 1, None, 2**60 + 1, 2**60 + 3, -(2**53) - 1]
TEXTS = ["the cat sat on a mat and slept there", "of this and that there is no end at all", None, "une autre chose encore et la suite", "x"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(zip(IDS, TEXTS, strict=True)), "doc_id long, text string").coalesce(1)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, rng.normal(size=16).tolist(), 1) for i in IDS], "vec_id long, embedding array<float>, label int").coalesce(1)


def ids(frame, column="doc_id"):
    return sorted((r[0] for r in frame.select(column).collect()), key=lambda i: (i is not None, i or 0))


ALL = sorted(IDS, key=lambda i: (i is not None, i or 0))


def test_documents(spark, docs):
    assert ids(packing.pack_documents(docs, tokenizer(), 64)) == ALL
    assert ids(packing.assign_sequences(docs.withColumn("length", F.lit(3)), 8)) == ALL
    assert ids(bpe.decode(bpe.encode(docs, tokenizer()), tokenizer())) == ALL
    assert ids(neardup.near_duplicates(docs), "_id") == ALL
    learned = langid.training_texts(docs.withColumn("lang", F.lit("en")), F.lit(True))
    assert ids(langid.identify(docs, learned)) == ALL
    assert ids(substrings.remove_repeats(docs)) == ALL
    labels = spark.createDataFrame([(i, k % 2, k % 2) for k, i in enumerate(IDS)], "doc_id long, toxic int, quality int")
    model = toxicity.train(*toxicity.labelled_sample(docs, labels, F.lit(True)))
    assert ids(toxicity.score(docs, model)) == ALL
    assert ids(quality.judge(docs, labels, F.lit(True))) == ALL


def test_pages(spark, docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.org/"), F.coalesce("text", F.lit(""))).alias("url"), F.col("text").alias("html"))
    assert ids(html.extract_text(pages), "page_id") == ALL
    assert ids(urls.judge_urls(pages, ["org/"], ["com/"]), "page_id") == ALL


def test_vectors(vectors):
    assert ids(codes.with_label_error(codes.compress(vectors)), "vec_id") == ALL
    known = [i for i in ALL if i is not None]
    for found in (topk.exact_topk(vectors, F.col("vec_id").isNotNull(), 5), ann.nearest(vectors, F.col("vec_id").isNotNull(), 5)):
        assert ids(found.select("query_id").distinct(), "query_id") == known
        assert set(ids(found.select("vec_id").distinct(), "vec_id")) >= set(known)

"""The quality classifier: plain loops beside its sums, and held-out accuracy on the given labels."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeweave.llm import quality
from treeweave.llm.queries import QUERIES
from treeweave.llm.shared import table


def good_text(rng):
    return " ".join("".join(rng.choice("aeinrtsho") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(3, 80))) + "."


def bad_text(rng):
    return " ".join(w.upper() + "!!" for w in good_text(rng).split())


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(7)
    rows = [(2**53 + 1 + i, bad_text(rng) if i % 3 == 0 else good_text(rng), int(i % 3 != 0)) for i in range(240)]
    docs = spark.createDataFrame([(i, t, "s", i) for i, t, _ in rows], "doc_id long, text string, score string, stats long")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"), rows


def test_cosines_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, len(quality.STATISTICS))) * 0.7
    z = quality.Kernel(np.zeros(x.shape[1]), np.ones(x.shape[1])).cosines(x)[:, :-1]
    squared = ((x[:, None] - x) ** 2).sum(axis=2)
    gauss = np.exp(-squared / (2 * quality.WIDTH**2 * x.shape[1]))
    assert np.abs(z @ z.T - gauss).max() < 0.3 and np.abs(z @ z.T - gauss).mean() < 0.06


def test_partition_sums_are_those_of_a_loop(spark, sample):
    docs, _, rows = sample
    measured = {r["doc_id"]: np.array(r["stats_"]) for r in quality.measure(docs, name="stats_").collect()}
    stats = np.array([measured[i] for i, _, _ in rows])
    kernel = quality.Kernel(stats.mean(0), np.where(stats.std(0) > 1e-9, stats.std(0), 1))
    folded = spark.createDataFrame([(k % 5, float(y), measured[i].tolist()) for k, (i, _, y) in enumerate(rows)], "fold int, y double, stats array<double>").repartition(7)
    a, b, squares = quality.normal_equations(folded, kernel)
    for f in range(quality.FOLDS):
        z, y = kernel.cosines(stats[f::5]), np.array([r[2] for r in rows[f::5]], float)
        slow = sum(np.outer(v, v) for v in z)
        assert np.allclose(a[f], slow) and np.allclose(b[f], sum(v * t for v, t in zip(z, y, strict=True))) and squares[f] == y.sum()
    w = quality.ridge(a.sum(0), b.sum(0), 0.1)
    z, y = kernel.cosines(stats), np.array([r[2] for r in rows], float)
    stacked = np.concatenate([z, np.sqrt(np.diag([0.1] * quality.FEATURES + [1e-9]))])
    assert np.allclose(z @ w, z @ np.linalg.lstsq(stacked, np.concatenate([y, np.zeros(quality.FEATURES + 1)]), rcond=None)[0], atol=1e-6)


def test_isotonic_against_minimax():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 12):
        v, w = rng.integers(0, 4, n).astype(float), rng.integers(1, 4, n).astype(float)
        found = np.concatenate([[x] * (b - a + 1) for a, b, x in quality.isotonic(v, w)])
        mean = [[v[i : k + 1] @ w[i : k + 1] / w[i : k + 1].sum() if k >= i else 0 for k in range(n)] for i in range(n)]
        assert np.allclose(found, [max(min(mean[i][k] for k in range(j, n)) for i in range(j + 1)) for j in range(n)])


def test_scores_rise_with_raw_ones(sample, spark):
    raw, good = quality.calibration([(-10, 5, 0.0), (0, 4, 1.0), (3, 4, 0.0), (200, 3, 3.0)])
    assert (np.diff(raw) > 0).all() and (np.diff(good) >= 0).all() and good.min() >= 0 and good.max() <= 1


def test_learned_from_usable_labels_only(spark, sample):
    docs, labels, rows = sample
    flipped = labels.withColumn("quality", F.when(F.col("doc_id") % 4 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    found = quality.judge(docs, flipped, F.col("doc_id") % 4 != 0)
    assert found.columns == ["doc_id", "stats", "score", "predicted"]  # the own score column gives way
    right = {i: y for i, _, y in rows}
    assert all(r["predicted"] == right[r["doc_id"]] == (r["score"] >= 0.5) for r in found.collect())


def test_odd_texts_and_ids(spark, sample):
    docs, labels, _ = sample
    odd = [(2**53 + 1, None), (None, ""), (2**53 + 3, " \n\t"), (None, "x" * 300_000), (1, "日本語 🙂 \x00"), (1, "long words " * 60_000), (1, "!"), (5, None)]
    more = labels.unionByName(spark.createDataFrame([(None, 1), (1, 0), (1, 1), (5, None)], "doc_id long, quality int"))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    found = quality.judge(both, more, F.lit(True)).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in found) == sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in both.collect())
    assert all(0 <= r["score"] <= 1 and math.isfinite(r["score"]) and r["predicted"] == (r["score"] >= 0.5) for r in found)


def test_statistics_whatever_the_slices(monkeypatch):
    text = "Aé 日本 12!! | x\n" * 50
    whole = quality.statistics_of(text)
    monkeypatch.setattr(quality, "SLICE", 7)
    assert quality.statistics_of(text) == whole and len(whole) == len(quality.STATISTICS)
    assert quality.statistics_of(None) == quality.statistics_of("")


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0), ([(1, 0), (1, 1)], 0.5)])
def test_labels_that_teach_nothing(spark, labels, score):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [r["score"] for r in quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True)).collect()] == [score] * 2
    assert quality.judge(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True)).collect() == []


@pytest.mark.parametrize(("sf", "least"), [("0.01", 0.98), ("0.1", 0.995)])
def test_held_out_accuracy(spark, sf, least):
    d = f"/root/testdata/sf{sf}"
    rows = QUERIES["op11_fourier_ridge"](spark, d)
    assert rows.count() == table(spark, d, "documents").count()
    found = rows.join(table(spark, d, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    unseen = [r for r in found if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in unseen) >= least * len(unseen)
    # calibrated: documents about as good as their scores say
    assert abs(np.mean([r["score"] - r["quality"] for r in unseen])) < 0.02

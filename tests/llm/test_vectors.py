"""Searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeweave.llm import ann, topk


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [float(x) if x is not None else None for x in v], "s") for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, score string")


def brute(vectors, ids, queries, k, score):
    out = []
    for q in queries:
        s = [(-score(vectors[q], vectors[j]), ids[j]) for j in range(len(vectors)) if ids[j] != ids[q]]
        out += [(ids[q], rank + 1, i, -x) for rank, (x, i) in enumerate(sorted(s)[:k])]
    return out


def test_exact_topk(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((300, 8)) * 0.3
    v[40:60] = v[40]  # ties
    v[5] = 0
    odd = [None, [1.0, float("nan")], [float("inf")] * 8, [None] * 8, []]
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    df = frame(spark, [*v, *odd], [*range(300), 300, 301, 302, 303, 304])
    got = topk.exact_topk(df, F.col("vec_id") % 20 == 0, 7).collect()
    ints = np.floor(64 * v).astype(int)
    want = brute(ints, [*range(300)], range(0, 300, 20), 7, lambda a, b: int(a @ b))
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.exact_topk(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.exact_topk(df.filter("vec_id < 3"), F.col("vec_id") % 20 == 0, 7).count() == 2  # fewer candidates than asked for


def test_threshold_stops_early():
    rng = np.random.default_rng(1)
    c = (rng.standard_normal((2000, 3)) * np.array([100, 1, 1])).astype(int)
    q = np.array([[50, 0, 1]])
    i, ids, s, met = topk.threshold_topk(q, c, np.arange(2000), np.array([-1]), 5)
    assert sorted(s)[::-1] == sorted(c @ q[0])[::-1][:5]
    assert met[0] < 0.05


def test_a_floor_from_elsewhere_stops_the_walk():
    rng = np.random.default_rng(3)
    c = rng.integers(-9, 10, (4000, 4))
    q = np.array([[3, 1, -2, 0], [1, 1, 1, 1]])
    best = np.sort(q @ c.T, axis=1)[:, ::-1]
    alone = topk.threshold_topk(q, c, np.arange(4000), np.array([-1, -1]), 20)
    i, ids, s, met = topk.threshold_topk(q, c, np.arange(4000), np.array([-1, -1]), 20, best[:, 0] + 1)
    assert not len(i) and (met < alone[3]).all()
    i, ids, s, _ = topk.threshold_topk(q, c, np.arange(4000), np.array([-1, -1]), 20, best[:, 19])
    assert [sorted(s[i == k])[::-1] for k in (0, 1)] == [best[k, :20].tolist() for k in (0, 1)]


def test_scores_are_exact_beyond_floats():
    for scale, d in ((2**27, 64), (2**40, 3), (2**62, 2)):
        rng = np.random.default_rng(4)
        c = np.array([[int(x) for x in rng.integers(-scale, scale, d)] for _ in range(50)], np.int64)
        _, ids, s, _ = topk.threshold_topk(c[:1], c, np.arange(50), np.array([0]), 5)
        exact = sorted(((min(max(sum(int(x) * int(y) for x, y in zip(c[0], r)), -(2**63)), 2**63 - 1), -j) for j, r in enumerate(c) if j), reverse=True)[:5]
        assert sorted(((int(x), -int(j)) for x, j in zip(s, ids)), reverse=True) == exact


def test_hilbert_curve_is_continuous():
    g = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = ann.hilbert_keys(g, 3)
    assert sorted(keys) == [*range(512)]
    assert (np.abs(np.diff(g[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_nearest(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((600, 16))
    v[100:140] = v[100]  # equal vectors, one direction at two lengths
    v[140:150] = 2 * v[100]
    odd = [None, [0.0] * 16, [float("nan")] * 16]
    df = frame(spark, [*v, *odd], range(603))
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, 5).collect()
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    want = brute(v, [*range(600)], range(0, 600, 50), 5, cos)
    by = lambda rows: {(q, i) for q, _, i, _ in map(tuple, rows)}
    assert len(got) == len(want)
    clear = [w for w in want if w[0] != 100]  # among equal directions rounding decides
    assert len(by(got) & by(clear)) >= 0.9 * len(clear)
    own = [r for r in got if r["query_id"] == 100]
    assert all(r["score"] > 1 - 1e-9 for r in own) and 100 not in {r["vec_id"] for r in own}
    for r in got:
        assert r["score"] == pytest.approx(cos(v[r["query_id"]], v[r["vec_id"]]), abs=1e-12)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_blocks_of_the_windows_dont_matter(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = frame(spark, rng.standard_normal((300, 12)))
    monkeypatch.setattr(ann, "ORDERINGS", 6)
    monkeypatch.setattr(ann, "measured_window", lambda *a: 20)
    found = []
    for block in (7, 2048):
        monkeypatch.setattr(ann, "BLOCK", block)
        found.append(sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 10 == 0, 5).collect())))
    assert found[0] == found[1] and len(found[0]) == 150


def test_lengths_of_vectors_dont_matter(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((60, 4))
    far = [x * s for x, s in zip(v, np.resize([1e-200, 1.0, 1e200], 60))]
    got = ann.nearest(frame(spark, far), F.col("vec_id") % 20 == 0, 3).collect()
    assert len(got) == 9
    for r in got:
        a, b = v[r["query_id"]], v[r["vec_id"]]
        assert r["score"] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_vectors_of_unlike_lengths(spark):
    empty = frame(spark, [[], [], []])
    got = sorted(map(tuple, topk.exact_topk(empty, F.col("vec_id") == 0, 5).collect()))
    assert got == [(0, 1, 1, 0), (0, 2, 2, 0)]
    mixed = frame(spark, [[1.0, 2.0], [], [3.0], [0.5, 0.25, 9.0]])
    got = {r["vec_id"]: r["score"] for r in topk.exact_topk(mixed, F.col("vec_id") == 0, 5).collect()}
    assert got == {1: 0, 2: 64 * 192, 3: 64 * 32 + 128 * 16}

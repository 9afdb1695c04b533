"""Vector codes against a loop in Python's integers, and the registered query against its SQL."""

import hashlib
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from treeweave.llm import codes
from treeweave.llm.queries import ORACLE_SQL, QUERIES


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    """The contract, read off; rows are (vec_id, label, vector)."""

    def fits(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    def exact(x):
        n, d = float(x).as_integer_ratio()
        return n * scale // d

    kept = sorted((r for r in rows if fits(r[2])), key=lambda r: (r[0] is None, r[0], r[2]))
    width = next((len(r[2]) for r in kept if len(r[2]) % parts == 0), None)
    kept = [(i, lab, [exact(x) for x in v]) for i, lab, v in kept if len(v) == width]
    if not kept:
        return []
    size = width // parts
    books = [[v[p * size : (p + 1) * size] for _, _, v in kept[:entries]] for p in range(parts)]

    def near(part, book):
        distances = [sum((x - c) ** 2 for x, c in zip(part, entry, strict=True)) for entry in book]
        return distances.index(min(distances)), min(distances)

    for _ in range(rounds):
        for p, book in enumerate(books):
            held = {}
            for _, _, v in kept:
                part = v[p * size : (p + 1) * size]
                held.setdefault(near(part, book)[0], []).append(part)
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e], strict=True)] if e in held else entry for e, entry in enumerate(book)]
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    found = [(i, lab, [near(v[p * size : (p + 1) * size], books[p]) for p in range(parts)]) for i, lab, v in kept]
    out = [(i, lab, "".join(f"{c:02x}" for c, _ in f), min(sum(d for _, d in f), 2**63 - 1)) for i, lab, f in found]
    totals = {}
    for _, lab, _, e in out:
        totals[lab] = totals.get(lab, 0) + e
    return [(i, c, e, min(totals[lab], 2**63 - 1), digest) for i, lab, c, e in out]


def by_row(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


def run(spark, rows, kind="float", **how):
    table = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>")
    found = codes.with_label_error(codes.compress(table, **how))
    return by_row(found.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "label", "embedding")
    rows = [tuple(r) for r in table.collect()]
    assert by_row(QUERIES["op12_integer_codebooks"](spark, "/root/testdata/sf0.001").collect()) == by_row(plain(rows))


def test_odd_vectors(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(2**53 + 1 + i // 2, i % 3 or None, [round(rng.gauss(0, 1) * 8) / 8 for _ in range(32)]) for i in range(150)]
    rows += [(None, 1, rows[0][2]), (None, 1, rows[0][2]), rows[5], (5, 9, None), (6, 9, [None] * 32), (7, 9, [float("nan")] * 32), (8, 9, [1.0] * 31 + [float("inf")]), (1, 2, [])]
    rows += [(9, None, [0.5] * 16), (10, 1, [1.0] * 31)]
    monkeypatch.setattr(codes, "FEW_LABELS", 2)
    monkeypatch.setattr(codes, "ROWS", 7)
    expected = by_row(plain([r for r in rows if r[2] != []]))
    assert run(spark, [r for r in rows if r[2] != []]) == expected
    assert run(spark, [r for r in rows if r[0] != 1 and r[0] != 9], entries=5, rounds=3) == by_row(plain([r for r in rows if r[0] != 1 and r[0] != 9], entries=5, rounds=3))
    assert run(spark, rows) == by_row(plain(rows))  # the smallest key's vector is empty: empty ones alone


@pytest.mark.parametrize("size", [2.0**18, 2.0**33, 1e30, 1e200])
def test_large_components(spark, size):
    rng = random.Random(6)
    rows = [(i, i % 2, [rng.uniform(-size, size) if rng.random() < 0.5 else rng.random() for _ in range(16)]) for i in range(40)]
    assert run(spark, rows, "double", entries=6) == by_row(plain(rows, entries=6))


def test_tables_without_vectors(spark):
    assert run(spark, []) == [] and run(spark, [(1, 1, None), (2, 1, [float("nan")] * 16)]) == []
    assert [r[1] for r in run(spark, [(1, 1, [0.25] * 16)])] == ["00" * 16]


def test_other_columns_stay(spark):
    rows = [(i, [float(i)] * 16, i, "x") for i in range(4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, error long, `a b c` string")
    found = codes.compress(table)
    assert found.columns == ["vec_id", "a b c", "code", "error", "codebooks_sha256"] and found.count() == 4
    named = codes.with_label_error(found.withColumn("_label", F.lit(1)).withColumn("_total", F.lit(2)), "a b c")
    assert named.columns == ["vec_id", "a b c", "code", "error", "codebooks_sha256", "_label", "_total", "label_error"]


def test_limbs():
    for v in (0, 1, -1, 2**31, -(2**31), -(2**31) - 1, 2**62 + 5, -(2**90) - 7, 10**40):
        assert sum(x << codes.LIMB * k for k, x in enumerate(codes.limbs(v))) == v


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    expected = con.execute(ORACLE_SQL["op12_integer_codebooks"]).fetchall()
    names = [c[0] for c in con.description]
    assert by_row(QUERIES["op12_integer_codebooks"](spark, d).select(*names).collect()) == by_row(expected)

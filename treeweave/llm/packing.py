"""Best-fit packing of token sequences (best-two-fit), planned on the histogram of lengths.

A plan needs lengths only, of which there are no more than the capacity, whatever the number of
documents. So the plan is made from the histogram: a *pattern* is the content of one sequence, as a
multiset of lengths, and how many sequences repeat it. Documents then find their places without any
driver or single task seeing them: the r-th document of a length takes the r-th place that the
plan holds for that length.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bpe import token_batches
from .shared import fresh, staged

#: Rows of a (length, salt) group, about, when all rows have one length: what one task numbers.
SALTED = 2_000_000

PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """Each document's ids and then ``separator``, cut into pieces of ``capacity`` ids only if longer.

    Returns doc_id, piece, start, length and ids (little-endian unsigned 32-bit numbers). A null or empty text
    is the separator alone. Repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([separator], "<u4").tobytes()
        for part, found in token_batches(batches, path, "text"):
            cut = [(d, x + end) for d, x in zip(part.column("doc_id").to_pylist(), found, strict=True)]
            rows = [(d, k, k * capacity, x[4 * k * capacity : 4 * (k + 1) * capacity]) for d, x in cut for k in range(-(-len(x) // (4 * capacity)))]
            ids = pa.array([r[3] for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([len(r[3]) // 4 for r in rows], pa.int64()), ids],
                names=PIECE.names,
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE)


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each repeats, using up the histogram.

    A sequence is filled greedily with the longest length that still fits. Then its shortest document
    is taken out, and the two unpacked documents that fill the widened gap best take its place if they leave less room.
    A pattern repeats for as long as its lengths last, so the patterns number some times the distinct lengths.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left)
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(n: int, by: int = 1) -> None:
        left[n] -= by
        if not left[n]:
            lengths.remove(n)

    def put(n: int) -> None:
        if not left[n]:
            insort(lengths, n)
        left[n] += 1

    while lengths:
        before = dict(left)
        inside: list[int] = []
        gap = capacity
        while (k := bisect_right(lengths, gap)) > 0:
            n = lengths[k - 1]
            fit = min(left[n], gap // n) if inside else 1
            inside += [n] * fit
            gap -= n * fit
            take(n, fit)
        if gap and len(inside) > 1:
            smallest = inside[-1]
            wide = gap + smallest
            best: tuple[int, int, int] | None = None
            low, high = 0, bisect_right(lengths, wide) - 1
            while low <= high:  # two ends closing in: the best sum not over the gap
                a, b = lengths[low], lengths[high]
                if a + b > wide:
                    high -= 1
                    continue
                if low != high or left[a] > 1:
                    best = max(best or (0, 0, 0), (a + b, a, b))
                    if a + b == wide:
                        break
                low += 1
            if best and best[0] > smallest:
                inside.pop()
                put(smallest)
                for n in best[1:]:
                    take(n)
                    inside.append(n)
        used = {n: inside.count(n) for n in set(inside)}
        times = min(before[n] // u for n, u in used.items())
        for n, u in used.items():
            if times > 1:
                take(n, u * (times - 1))
        plan.append((tuple(sorted(inside, reverse=True)), times))
    return plan


def assign_sequences(pieces: DataFrame, capacity: int = 2048, length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: at most ``capacity`` in a sequence, no gaps from 0 on.

    ``pieces`` is read three times: stage it if it is dear. Lengths run from 1 to ``capacity``; others (and nulls)
    are an error. Equal rows are different pieces. No rows: no sequences.

    Rows of one length, however many, are numbered within (length, salt) groups, whose first
    numbers come from the groups' counts.
    """
    spark = pieces.sparkSession
    salts = max(8, -(-pieces.count() // SALTED))
    salt, n_, base_, k_, rank_ = fresh(pieces.columns, "_salt", "_n", "_base", "_k", "_rank")
    order = [F.col(f"`{c}`") for c, t in pieces.dtypes if not t.startswith("map")]
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    groups = staged(salted.groupBy(length, salt).agg(F.count(F.lit(1)).alias(n_)), "lengths")
    histogram = {r[0]: r[1] for r in groups.groupBy(length).agg(F.sum(n_)).collect()}  # a row for each length: at most `capacity`
    if any(n is None or not 1 <= n <= capacity for n in histogram):
        raise ValueError(f"lengths must run from 1 to {capacity}")
    plan = best_two_fit(histogram, capacity)
    starts: dict[int, list[tuple[int, int, int, int, int]]] = {}  # by length: first number, number a sequence, first sequence, which in it, offset
    taken = dict.fromkeys(histogram, 0)
    first = 0
    for inside, times in plan:
        at = 0
        for n in dict.fromkeys(inside):
            u = inside.count(n)
            starts.setdefault(n, []).append((taken[n], u, first, at, 0))
            taken[n] += u * times
            at += n * u
        first += times
    places = {n: np.array(x, np.int64) for n, x in starts.items()}
    before = Window.partitionBy(length).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    base = groups.select(length, salt, F.coalesce(F.sum(n_).over(before), F.lit(0)).alias(base_))
    numbered = (
        salted.withColumn(k_, F.row_number().over(Window.partitionBy(length, salt).orderBy(*order)))
        .join(F.broadcast(base) if len(histogram) * salts <= 500_000 else base, [length, salt])
        .select(*(F.col(f"`{c}`") for c in pieces.columns), (F.col(base_) + F.col(k_) - 1).alias(rank_))
    )
    held = spark.sparkContext.broadcast(places)  # some tens of thousands of rows of 40 bytes, bounded by the number of lengths

    kept = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column(length).to_numpy(), batch.column(rank_).to_numpy()
            order = np.argsort(lengths, kind="stable")
            found, first = np.unique(lengths[order], return_index=True)
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for n, rows in zip(found.tolist(), np.split(order, first[1:]), strict=True):
                p, rank = held.value[n], ranks[rows]
                at = p[np.searchsorted(p[:, 0], rank, "right") - 1]
                sequence[rows] = at[:, 2] + (rank - at[:, 0]) // at[:, 1]
                offset[rows] = at[:, 3] + (rank - at[:, 0]) % at[:, 1] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=schema.names)

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """Tokenize, cut and pack ``docs`` (doc_id, text); a digest stands for each piece's ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null ids are kept; other columns are not looked at.
    """
    pieces = token_pieces(docs, path, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return assign_sequences(staged(pieces, "pieces"), capacity)

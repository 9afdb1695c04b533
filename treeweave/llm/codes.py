"""Vector code compression: vectors cut into equal parts, each written as the index of its nearest codebook entry.

Codebooks are whole numbers, few and of fixed size, and travel to the tasks. A batch computes all distances of a part by norm
expansion, |x|^2 - 2 x c + |c|^2, from exact products of 64-bit integers. For the next round a task adds up the parts of each entry;
these sums meet in a grouped shuffle, one row for each part, entry and limb of the sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, staged

#: Components up to this size keep all distances of parts of up to 64 components within 64 bits; larger ones are computed as Python's integers.
EXACT = 1 << 27
#: Sums travel in limbs of so many bits: whatever their size, adding up limbs of a billion tasks stays within 64 bits.
LIMB = 31
MOST = (1 << 63) - 1
#: Rows of a batch that are computed at a time.
ROWS = 4096
#: Labels whose sums are broadcast; more are joined by a shuffle.
FEW_LABELS = 5_000


def usable(vector: Column, width: int | None = None) -> Column:
    """Whether a vector takes part: not null, without null or non-finite components, and of the given length."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite if width is None else finite & (F.size(vector) == width), F.lit(False))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: 64-bit integers if all are within EXACT, else Python's."""
    # a power of two only moves the exponent; where that overflows, Python's integers do the product
    x = values.astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = x * scale
    if not scaled.size or np.abs(scaled).max() <= EXACT:
        return np.floor(scaled).astype(np.int64)
    out = np.empty(x.shape, object)
    out.flat = [(n * scale) // d for n, d in (v.as_integer_ratio() for v in x.ravel().tolist())]
    return out


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry, the first of equals, and the squared distance."""
    if not parts.shape[1]:
        return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    d = (parts * parts).sum(axis=1)[:, None] - 2 * parts.dot(entries.T) + (entries * entries).sum(axis=1)
    code = d.argmin(axis=1)
    return code, d[np.arange(len(d)), code]


class Codebooks:
    """Entries by part: an array of (parts, entries, components), of 64-bit integers where that is exact."""

    def __init__(self, entries: np.ndarray):
        big = entries.dtype == object and entries.size and max(abs(x) for x in entries.ravel().tolist()) > EXACT
        self.entries = entries if big else entries.astype(np.int64)
        self.big = bool(big)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances, (vectors, parts) each."""
        wide = self.big or vectors.dtype == object
        x, c = (vectors.astype(object), self.entries.astype(object)) if wide else (vectors, self.entries)
        x = x.reshape(len(vectors), len(c), -1)
        found = [nearest(x[:, p], c[p]) for p in range(len(c))]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def vectors_of(batch: pa.RecordBatch, column: str, scale: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """A batch in slices, with their vectors as integers."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        flat = pc.list_flatten(part.column(column)).to_numpy(zero_copy_only=False)
        yield part, integers(flat.reshape(part.num_rows, width), scale)


def limbs(value: int) -> list[int]:
    """A whole number in limbs of LIMB bits, lowest first; all but the last are not negative."""
    out = []
    while not -(1 << LIMB) <= value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def entry_sums(vectors: DataFrame, books: Codebooks, column: str, scale: int, width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """By part and entry: how many parts are nearest to it, and the sum of their components; entries without any are left out.

    A task sends one row for each part, entry and limb; the driver gets as many, summed over all tasks.
    """
    parts, count, size = books.entries.shape
    held = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = held.value
        totals, numbers = np.zeros((parts, count, size), object), np.zeros((parts, count), np.int64)
        for batch in batches:
            for _, x in vectors_of(batch, column, scale, width):
                codes, _ = book.assign(x)
                x = x.reshape(len(x), parts, size)
                for p in range(parts):
                    sums = np.zeros((count, size), x.dtype)
                    np.add.at(sums, codes[:, p], x[:, p])
                    totals[p] += sums.astype(object)
                    numbers[p] += np.bincount(codes[:, p], minlength=count)
        rows = []
        for p, e in zip(*np.nonzero(numbers), strict=True):
            split = [limbs(int(v)) for v in totals[p, e]]
            for k in range(max([1, *map(len, split)])):
                rows.append((int(p), int(e), k, int(numbers[p, e]) if k == 0 else 0, *(s[k] if k < len(s) else 0 for s in split)))
        if rows:
            kinds = [pa.int32()] * 3 + [pa.int64()] * (1 + size)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    sums = [f"s{i}" for i in range(size)]
    names = ["part", "entry", "limb", "number", *sums]
    schema = "part int, entry int, limb int, number long" + "".join(f", {s} long" for s in sums)
    found: dict[tuple[int, int], tuple[int, list[int]]] = {}
    merged = vectors.select(column).mapInArrow(run, schema).groupBy("part", "entry", "limb").agg(*(F.sum(c).alias(c) for c in names[3:]))
    for part, entry, limb, number, *values in merged.collect():
        n, old = found.get((part, entry), (0, [0] * size))
        found[part, entry] = n + number, [a + (b << LIMB * limb) for a, b in zip(old, values, strict=True)]
    return found


def fit(vectors: DataFrame, key: str, column: str, parts: int, entries: int, rounds: int, scale: int) -> tuple[Codebooks, int] | None:
    """Codebooks, and the length of vectors; None where no vector takes part."""
    order = [F.asc_nulls_last(key), F.col(column)]
    first = vectors.filter(usable(F.col(column)) & (F.size(column) % parts == 0)).select(key, column).orderBy(*order).limit(1).collect()
    if not first:
        return None
    width = len(first[0][1])
    same = vectors.filter(usable(F.col(column), width))
    start = same.select(key, column).orderBy(*order).limit(entries).collect()
    x = integers(np.array([r[1] for r in start], np.float64).reshape(len(start), width), scale)
    books = Codebooks(x.reshape(len(start), parts, width // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        moved = books.entries.astype(object)
        for (p, e), (n, sums) in entry_sums(same, books, column, scale, width).items():
            moved[p, e] = [s // n for s in sums]
        books = Codebooks(moved)
    return books, width


def compress(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """``key``, code, error and codebooks_sha256 for each vector that takes part; other columns stay, too, but ``column``.

    code: two hexadecimal digits for each part, so at most 256 entries; error: squared distances of the whole numbers, summed over parts (at most
    2**63 - 1, where it would be more); codebooks_sha256: digest of all entries' components by part, entry and position.

    Codebooks start as the parts of the ``entries`` smallest keys (fewer, if there are fewer; null keys last, equal keys by their vectors). Null vectors and
    those with null or non-finite components are left out; so are vectors of another length than the one with the smallest key whose length
    ``parts`` divides. Repeated rows count each. No rows: none. ``vectors`` is read ``rounds`` + 3 times: stage it if it is dear.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    own = ["code", "error", "codebooks_sha256"]
    kept = [c for c in vectors.columns if c not in (column, *own)]
    schema = vectors.select(*(F.col(f"`{c}`") for c in kept)).schema.add("code", "string").add("error", "long").add("codebooks_sha256", "string")
    found = fit(vectors, key, column, parts, entries, rounds, scale)
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    books, width = found
    digest = books.digest()
    held = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in vectors_of(batch, column, scale, width):
                codes, distances = held.value.assign(x)
                errors = [min(int(e), MOST) for e in distances.astype(object).sum(axis=1)] if distances.dtype == object else distances.sum(axis=1)
                written = [row.tobytes().hex() for row in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(written, pa.string()), pa.array(errors, pa.int64()), pa.array([digest] * part.num_rows, pa.string())], names=schema.names
                )

    same = vectors.filter(usable(F.col(column), width))
    return same.select(*(F.col(f"`{c}`") for c in kept), F.col(column)).mapInArrow(run, schema)


def with_label_error(coded: DataFrame, label: str = "label", error: str = "error", name: str = "label_error") -> DataFrame:
    """``coded`` with the sum of ``error`` over the rows of its label; null labels together. A sum over 2**63 - 1 is given as that.

    Sums are one row a label, added up before they are shuffled, so a hot label costs one row a task; the join back is N:1.
    """
    rows = staged(coded, "codes")
    own, total = fresh(rows.columns, "_label", "_total")
    sums = rows.groupBy(F.col(f"`{label}`").alias(own)).agg(F.least(F.sum(F.col(error).cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias(total))
    sums = staged(sums, "label-errors")
    if sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    return rows.join(sums, F.col(f"`{label}`").eqNullSafe(F.col(own))).drop(own).withColumnRenamed(total, name)

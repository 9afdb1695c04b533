"""Approximate nearest neighbours over shifted space-filling curves.

Many times over, vectors are projected at random to a few dimensions, shifted, and put on a Hilbert curve; Spark
range-partitions and sorts the curve keys, which gives every vector a rank in every ordering. A query's candidates are
the rows within ``window`` ranks of its own in any ordering. They are compared by sketches of one byte a component, and
the best of all orderings are reranked by the cosine of the original vectors.

The window isn't guessed: a bounded sample of queries is answered by brute force, and the window is the
rank distance within which the wanted share of their true neighbours lies in some ordering.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import staged
from .topk import usable

#: Orderings, the dimensions of a projection, and the bits of a curve key.
ORDERINGS, DIMENSIONS, KEY_BITS = 96, 20, 60
#: Queries that the window is measured on, the share of their neighbours to find, and the points that centre and scale the projections.
SAMPLE, TARGET, CENTRED = 256, 0.93, 4096
#: Ranks of a block. Groups are pairs of a block of queries and a block of candidates, so no group grows with the table.
BLOCK = 2048
#: How far sketches may be off: what is this close to the last of the best is reranked as well.
MARGIN = 0.02


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Each row's place on the Hilbert curve; coordinates are integers below 2**bits (Skilling's transpose form)."""
    x = [c.astype(np.int64) for c in points.T]
    for b in range(bits - 1, 0, -1):
        high, low = 1 << b, (1 << b) - 1
        for i in range(len(x)):
            flip = (x[i] & high) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn = np.where(x[-1] & (1 << b), turn ^ ((1 << b) - 1), turn)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | ((c ^ turn) >> b) & 1
    return key


def axes(ordering: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """An ordering's projection and shift."""
    m = min(DIMENSIONS, d)
    rng = np.random.default_rng([7, ordering, d])
    return np.linalg.qr(rng.standard_normal((d, d)))[0][:, :m], rng.random(m) - 0.5


def scales(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean of some unit vectors, and their spread along the axes of every ordering."""
    centre = unit.mean(axis=0)
    spread = np.array([((unit - centre) @ axes(o, unit.shape[1])[0]).std(axis=0) for o in range(ORDERINGS)])
    return centre, np.where(spread > 0, spread, 1.0)


def curve_keys(unit: np.ndarray, ordering: int, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The keys of unit vectors in one ordering: its own projection and shift; three deviations either way fill the curve's cube."""
    projection, shift = axes(ordering, unit.shape[1])
    bits = min(16, KEY_BITS // len(shift))
    at = (unit - centre) @ projection / (6 * spread) + 0.5 + 0.1 * shift
    return hilbert_keys(np.clip(at * (1 << bits), 0, (1 << bits) - 1).astype(np.int64), bits)


def dense(vectors: pd.Series) -> np.ndarray:
    return np.array([*vectors], np.float64)


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # neither very long nor very short vectors leave the range of numbers
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def sketches(unit: np.ndarray) -> list[bytes]:
    """One byte a component, and the unit that it counts in."""
    step = np.abs(unit).max(axis=1, keepdims=True) / 127
    parts = np.rint(unit / step).astype(np.int8)
    return [s.tobytes() + r.tobytes() for s, r in zip(step.astype(np.float32), parts, strict=True)]


def from_sketches(found: pd.Series) -> np.ndarray:
    rows = np.frombuffer(b"".join(found), np.int8).reshape(len(found), -1)
    return rows[:, 4:].astype(np.float32) * rows[:, :4].copy().view(np.float32)


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors, in double precision; each is first divided by its largest component."""
    largest = lambda v: F.array_max(F.transform(v, F.abs))
    scaled = lambda v, by: F.transform(v, lambda x: x / by)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i * j), F.lit(0.0), lambda s, i: s + i)
    x, y = scaled(a, largest(a)), scaled(b, largest(b))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(x, y) / F.sqrt(dot(x, x)) / F.sqrt(dot(y, y))))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Each query's ``k`` nearest rows found, by cosine: query_id, rank (from 1), vec_id, score.

    Queries are the rows for which ``is_query`` holds; candidates all rows but the query's own id; equal scores go to the smaller id.
    Rows with a null id or a vector that is null, empty, zero or has null or non-finite components take no part. All vectors
    must have one dimension (an error otherwise). Equal vectors are one point of the index, which answers for their k + 1 smallest
    ids: no query needs more of them, and a vector that a third of the rows share weighs no more than another.
    """
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("id"),
        F.transform(F.col(f"`{embedding}`").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
    ).filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.filter(F.exists("v", lambda x: x != 0)).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    members = staged(rows.groupBy("h1", "h2", "id").agg(F.max("asked").alias("asked")), "members")
    points = staged(rows.groupBy("h1", "h2").agg(F.min_by("v", "id").alias("v"), F.max("asked").alias("asked"), F.min("id").alias("least")), "points")
    n, dims, other = points.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v"))).first()
    if dims != other:
        raise ValueError(f"vectors have {dims} to {other} dimensions")
    small = members.withColumn("_k", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).filter(F.col("_k") <= k + 1).drop("_k", "asked")
    places = with_ranks(points, n)
    window = measured_window(points, places, k)
    found = windows_compared(points, places, window, k)

    # of the best by sketches, and what is close to the last of them, the cosines of the vectors themselves
    best = Window.partitionBy("q1", "q2")
    found = found.groupBy("q1", "q2", "h1", "h2").agg(F.max("score").alias("score"))
    found = found.withColumn("_k", F.row_number().over(best.orderBy(F.desc("score"))))
    found = found.withColumn("last", F.max(F.when(F.col("_k") == k + 1, F.col("score"))).over(best))
    found = staged(found.filter((F.col("_k") <= k + 1) | (F.col("score") >= F.col("last") - MARGIN)).select("q1", "q2", "h1", "h2"), "best")
    theirs = points.select("h1", "h2", "least", F.col("v").alias("c"))
    asked = points.filter("asked").select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("v").alias("q"))
    found = found.join(theirs, ["h1", "h2"]).join(asked, ["q1", "q2"]).select("q1", "q2", "h1", "h2", "least", cosine(F.col("q"), F.col("c")).alias("score"))
    found = found.withColumn("_k", F.row_number().over(best.orderBy(F.desc("score"), "least"))).filter(F.col("_k") <= k + 1).drop("_k", "least")
    # a point stands for equal vectors, the query's own among them
    own_point = asked.select("q1", "q2", F.col("q1").alias("h1"), F.col("q2").alias("h2"), F.lit(1.0).alias("score"))
    found = staged(found.unionByName(own_point), "found").join(small, ["h1", "h2"]).select("q1", "q2", "id", "score")
    # equal vectors ask alike: one list of answers for each point, k + 1 long so that each can leave itself out
    answers = found.withColumn("_k", F.row_number().over(best.orderBy(F.desc("score"), "id"))).filter(F.col("_k") <= k + 1)
    answers = answers.groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col("id").alias("id")))).alias("list"))
    own = members.filter("asked").select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("id").alias("query_id")).join(answers, ["q1", "q2"])
    own = own.withColumn("list", F.slice(F.filter("list", lambda x: x["id"] != F.col("query_id")), 1, k))
    own = own.select("query_id", F.posexplode("list").alias("at", "x"))
    return own.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.less")).alias("score"))


def with_ranks(points: DataFrame, n: int) -> DataFrame:
    """(ordering, rank, h1, h2, asked): the place of each point in every ordering, found by a range-partitioned sort of the keys."""
    some = points.filter(F.pmod("h1", F.lit(max(1, n // (CENTRED // 2)))) == 0).limit(CENTRED).select("v").toPandas()
    centre, spread = scales(unit_rows(dense(some["v"]))) if len(some) else (np.zeros(1), np.ones((ORDERINGS, 1)))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            unit = unit_rows(dense(x["v"]))
            for o in range(ORDERINGS):
                yield pd.DataFrame({"ordering": np.full(len(x), o), "key": curve_keys(unit, o, centre, spread[o]), "h1": x["h1"], "h2": x["h2"], "asked": x["asked"]})

    laid = points.select("h1", "h2", "v", "asked").mapInPandas(keys, "ordering int, key long, h1 long, h2 long, asked boolean")
    laid = laid.repartitionByRange("ordering", "key", "h1", "h2").sortWithinPartitions("ordering", "key", "h1", "h2")
    laid = laid.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    laid = staged(laid.drop("key"), "laid")
    first = 0
    starts = {}
    for part, rows in sorted(laid.groupBy("part").agg(F.count(F.lit(1))).collect()):  # a row for each partition
        starts[part] = first
        first += rows
    start = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]) if starts else F.create_map().cast("map<int,int>")
    return laid.select("ordering", (F.col("at") + start[F.col("part")] - F.col("ordering").cast("long") * n).alias("rank"), "h1", "h2", "asked")


def measured_window(points: DataFrame, places: DataFrame, k: int) -> int:
    """The rank distance that finds the wanted share of a query sample's true neighbours."""
    sample = points.filter("asked").orderBy("h1", "h2").limit(SAMPLE).select("h1", "h2", "v").toPandas()
    if not len(sample):
        return 1
    asked = points.sparkSession.sparkContext.broadcast((sample["h1"].to_numpy(), sample["h2"].to_numpy(), unit_rows(dense(sample["v"]))))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q1, q2, unit = asked.value
        for x in batches:
            if not len(x):
                continue
            scores = unit @ unit_rows(dense(x["v"])).T
            h1, h2 = x["h1"].to_numpy(), x["h2"].to_numpy()
            scores[(q1[:, None] == h1) & (q2[:, None] == h2)] = -2
            top = np.argpartition(-scores, k - 1, axis=1)[:, :k] if len(x) > k else np.tile(np.arange(len(x)), (len(unit), 1))
            i, j = np.repeat(np.arange(len(unit)), top.shape[1]), top.ravel()
            yield pd.DataFrame({"q1": q1[i], "q2": q2[i], "h1": h1[j], "h2": h2[j], "score": scores[i, j]})

    true = points.select("h1", "h2", "v").mapInPandas(near, "q1 long, q2 long, h1 long, h2 long, score double").filter("score > -2")
    true = true.withColumn("_k", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "h1", "h2"))).filter(F.col("_k") <= k)
    true = staged(true.select("q1", "q2", "h1", "h2"), "true")  # k rows for each of the sample
    mine = places.join(F.broadcast(true.select(F.col("q1").alias("h1"), F.col("q2").alias("h2")).distinct()), ["h1", "h2"]).select("ordering", F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("rank").alias("mine"))
    gaps = places.join(F.broadcast(true), ["h1", "h2"]).select("ordering", "q1", "q2", "h1", "h2", "rank").join(mine, ["ordering", "q1", "q2"])
    found = gaps.groupBy("q1", "q2", "h1", "h2").agg(F.min(F.abs(F.col("rank") - F.col("mine"))).alias("gap")).select("gap").toPandas()["gap"].to_numpy()
    return int(max(1, np.quantile(found, TARGET, method="higher"))) if len(found) else 1


def windows_compared(points: DataFrame, places: DataFrame, window: int, k: int) -> DataFrame:
    """(q1, q2, h1, h2, score): of each query and ordering the best points within ``window`` ranks, by sketches."""

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                yield pd.DataFrame({"h1": x["h1"], "h2": x["h2"], "s": sketches(unit_rows(dense(x["v"])))})

    short = staged(points.select("h1", "h2", "v").mapInPandas(sketched, "h1 long, h2 long, s binary"), "sketches")
    placed = places.join(short, ["h1", "h2"])
    block = lambda rank: F.expr(f"({rank}) div {BLOCK}")
    last = places.agg(F.max("rank")).first()[0] or 0
    across = F.explode(F.sequence(block(f"greatest(0, rank - {window})"), block(f"least({last}, rank + {window})")))
    candidates = placed.withColumns({"cb": block("rank"), "qb": across}).select("ordering", "qb", "cb", "h1", "h2", "rank", "s")
    queries = staged(placed.filter("asked").withColumns({"qb": block("rank"), "cb": across}).select("ordering", "qb", "cb", "h1", "h2", "rank", "s"), "queries")

    def compare(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        if len(qs) and len(cs):
            cs = cs.sort_values("rank")
            q, c = from_sketches(qs["s"]), from_sketches(cs["s"])
            ranks, mine = cs["rank"].to_numpy(), qs["rank"].to_numpy()
            h1, h2, q1, q2 = cs["h1"].to_numpy(), cs["h2"].to_numpy(), qs["h1"].to_numpy(), qs["h2"].to_numpy()
            lows, highs = np.searchsorted(ranks, mine - window), np.searchsorted(ranks, mine + window, "right")
            for i, (lo, hi) in enumerate(zip(lows.tolist(), highs.tolist(), strict=True)):
                scores = c[lo:hi] @ q[i]
                scores[ranks[lo:hi] == mine[i]] = -2  # the query itself
                if len(scores) > k + 1:
                    keep = np.flatnonzero(scores >= max(np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1] - MARGIN, -1.5))
                else:
                    keep = np.flatnonzero(scores > -1.5)
                out.append((np.full(len(keep), q1[i]), np.full(len(keep), q2[i]), h1[lo + keep], h2[lo + keep], scores[keep].astype(np.float64)))
        columns = ("q1", "q2", "h1", "h2", "score")
        if not out:
            return pd.DataFrame({c: np.empty(0, np.float64 if c == "score" else np.int64) for c in columns})
        return pd.DataFrame({c: np.concatenate([x[j] for x in out]) for j, c in enumerate(columns)})

    both = queries.groupBy("ordering", "qb", "cb").cogroup(candidates.groupBy("ordering", "qb", "cb"))
    return both.applyInPandas(compare, "q1 long, q2 long, h1 long, h2 long, score double")

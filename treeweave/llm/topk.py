"""Exact top-k inner products: the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks of bounded size, queries too; each (query block, candidate block) is one
group, in which every dimension has a list of the block's candidates sorted by that component. A query walks
all lists at once, from the end that its component's sign favours, scores what it meets (random access), and stops
when the bound, the score of a vector made of the components last met, cannot beat its k-th best.

The k-th best is not the block's alone: a first pass over one candidate block gives each query a floor, and with it
the other blocks may stop before they have k candidates of their own, and return only what reaches it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import staged

#: Rows of a block of candidates and of a block of queries.
CANDIDATES, QUERIES = 8192, 2048
#: Lists are walked a share of a block at first, then twice as far each time.
FIRST_STEP = 1 / 512


def usable(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd, F.lit(False))


def best_of(rows: np.ndarray, scores: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores and their rows; equal scores go to the smaller place."""
    if len(rows) > k:
        kept = scores >= np.partition(scores, len(rows) - k)[len(rows) - k]  # and what ties with the last of them
        rows, scores = rows[kept], scores[kept]
        if len(rows) > k:
            kept = np.lexsort((place[rows], -scores))[:k]
            rows, scores = rows[kept], scores[kept]
    return rows, scores


def exactly(queries: np.ndarray, candidates: np.ndarray) -> np.dtype:
    """A type in which every sum of products is exact: floats up to 24 and 53 bits, then integers of 64 bits or any size."""
    most = candidates.shape[1] * int(np.abs(candidates.astype(object)).max(initial=0)) * int(np.abs(queries.astype(object)).max(initial=0))
    return np.dtype(np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**63 else object)


def threshold_topk(
    queries: np.ndarray, candidates: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query number, id, score) of each query's k best in a block, and the share of the block that each query met.

    ``own``: each query's id, which is no candidate of it. ``floor``: scores that the results of each query reach at least;
    lower ones aren't looked for. Integers; scores are exact; equal scores go to the smaller id.
    """
    n, d = candidates.shape
    order = np.argsort(candidates, axis=0, kind="stable").T.copy()  # one list a dimension, ascending
    kind = exactly(queries, candidates)
    exact, asked = candidates.astype(kind), queries.astype(kind)
    values = np.take_along_axis(exact.T, order, axis=1)
    place = np.empty(n, np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(n)
    best: list[tuple[np.ndarray, np.ndarray]] = []
    met = np.zeros(len(queries))
    for i, q in enumerate(asked):
        low = -np.inf if floor is None else floor[i]
        use = np.flatnonzero(q)
        up, down = use[q[use] > 0], use[q[use] < 0]
        seen = np.zeros(n, bool)
        rows, scores = np.empty(0, np.int64), np.empty(0, kind)
        depth, step = 0, max(1, int(n * FIRST_STEP)) if len(use) else n
        while depth < n:
            to = min(n, depth + step)
            fresh = np.full(n, to == n)
            fresh[order[up, n - to : n - depth]] = True
            fresh[order[down, depth:to]] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            new = new[ids[new] != own[i]]
            gained = exact[new] @ q
            if kind == object:  # what 64 bits can't hold stops at their ends
                gained = np.array([min(max(x, -(2**63)), 2**63 - 1) for x in gained], object)
            reach = gained >= low
            rows, scores = best_of(np.concatenate([rows, new[reach]]), np.concatenate([scores, gained[reach]]), place, k)
            bound = values[up, n - to] @ q[up] + values[down, to - 1] @ q[down]
            if bound < (max(low, scores.min()) if len(rows) >= k else low) or seen.all():
                break
            depth, step = to, 2 * step
        best.append((rows, scores))
        met[i] = seen.mean() if n else 0
    rows = np.concatenate([b[0] for b in best]) if best else np.empty(0, np.int64)
    scores = np.concatenate([b[1] for b in best]) if best else np.empty(0, np.int64)
    return np.repeat(np.arange(len(best)), [len(b[0]) for b in best]), ids[rows], scores.astype(np.int64), met


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Each query's ``k`` highest inner products with all other rows: query_id, rank (from 1), vec_id, score.

    Components become floor(``scale`` * x). Queries are the rows for which ``is_query`` holds; candidates all rows but
    the query's own id. Rows with a null id, or a vector that is null or has null or non-finite components, take no part.
    Vectors of unlike dimensions (empty ones too) are compared on the dimensions that both have. Repeated ids are one candidate each.
    Components and scores beyond 64 bits stop at the largest or smallest number of 64 bits. Fewer candidates: fewer rows.
    Every list but the queries' own answers stays in its block; no block grows with the data.
    """
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("id"),
        F.col(f"`{embedding}`").cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("q"),
    ).filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"), "q")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    c_blocks, q_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-n_queries // QUERIES))
    dealt = rows.withColumn("cb", F.pmod(F.xxhash64("id", "v"), F.lit(c_blocks)))
    asked = rows.filter("q").withColumn("qb", F.pmod(F.xxhash64("v", "id"), F.lit(q_blocks)))
    spread = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    right = dealt.withColumn("qb", spread(q_blocks)).select("qb", "cb", "id", "v")

    def search(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})
        if not len(qs) or not len(cs):
            return none
        d = max(qs["v"].map(len).max(), cs["v"].map(len).max())
        dense = lambda vs: np.array([np.pad(np.asarray(v, np.int64), (0, d - len(v))) for v in vs]).reshape(len(vs), d)
        own, floor = qs["id"].to_numpy(), qs["floor"].to_numpy(np.int64)
        i, ids, scores, _ = threshold_topk(dense(qs["v"]), dense(cs["v"]), cs["id"].to_numpy(), own, k, floor)
        return pd.DataFrame({"query_id": own[i], "vec_id": ids, "score": scores}) if len(i) else none

    def searched(left: DataFrame, right: DataFrame) -> DataFrame:
        both = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb"))
        return both.applyInPandas(search, "query_id long, vec_id long, score long")

    none = F.lit(-(2**63)).cast("long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ask = asked.select("qb", "id", "v").withColumn("floor", none)
    if c_blocks > 1:  # a query's k-th best in one block is its floor in all
        sample = searched(ask.withColumn("cb", F.lit(0).cast("long")).select("qb", "cb", "id", "v", "floor"), right.filter("cb = 0"))
        sample = sample.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        ask = staged(ask.drop("floor").join(sample, "id", "left").withColumn("floor", F.coalesce("floor", none)), "asked")
    found = searched(ask.withColumn("cb", spread(c_blocks)).select("qb", "cb", "id", "v", "floor"), right)
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

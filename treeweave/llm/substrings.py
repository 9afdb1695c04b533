"""Substring dedup: sliding spans of consecutive parts of sentences.

A sentence of more than WINDOW words is parted after each word whose hash is the least of some WINDOW consecutive words
of it (of equals, the last). So a part has at most WINDOW words, and where a passage is parted depends on the words
within WINDOW of the place only, not on the sentence around it. From every part a span runs over at least PARTS
parts and on until it has WORDS words. Spans are hashed and joined over the whole corpus; parts that any occurrence
but a span's first covers are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, let_go, staged

PARTS, WORDS, WINDOW = 2, 15, 8
#: A sentence with the white space after it: up to end marks before white space, or a line's end.
SENTENCE = re.compile(r"\S(?:[^.!?\n]|[.!?]+(?!\s|$|[.!?]))*(?:[.!?]+)?\s*")
TOKEN = re.compile(r"\S+\s*")


def least_of_windows(hashes: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Places of the least hashes (of equals, the last) of each WINDOW consecutive words that are of one sentence."""
    if len(hashes) < WINDOW:
        return np.empty(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    least, width = hashes << np.uint64(32) | (low - np.arange(len(hashes), dtype=np.uint64)), 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    least = least[sentence[: len(least)] == sentence[WINDOW - 1 :]]
    return np.unique((low - (least & low)).astype(np.int64))


def sentences(text: str) -> tuple[str, list[str], list[int]]:
    """What stands before the first sentence; the sentences or their parts, which joined give the rest; the words of each."""
    at = len(text) - len(text.lstrip())
    found = SENTENCE.findall(text, at)
    sizes = [len(s.split()) for s in found]
    # all words of the longer sentences but each one's last, after which a part ends anyway
    longer = [i for i, n in enumerate(sizes) if n > WINDOW]
    if not longer:
        return text[:at], found, sizes
    words = [w for i in longer for w in found[i].lower().split()[:-1]]
    sentence = np.repeat(longer, [sizes[i] - 1 for i in longer])
    hashes = np.array([xxhash.xxh32_intdigest(w.encode("utf-8", "replace")) for w in words], np.uint64)
    ends = least_of_windows(hashes, sentence)
    begins = dict(zip(longer, np.cumsum([0, *(sizes[i] - 1 for i in longer)]).tolist(), strict=False))
    cuts: dict[int, list[int]] = {i: [] for i in longer}
    for i, e in zip(sentence[ends].tolist(), ends.tolist(), strict=True):
        cuts[i].append(e - begins[i] + 1)
    parts: list[str] = []
    counts: list[int] = []
    for i, s in enumerate(found):
        if i not in cuts:
            parts.append(s)
            counts.append(sizes[i])
            continue
        tokens, lo = TOKEN.findall(s), 0
        for hi in (*cuts[i], sizes[i]):
            parts.append("".join(tokens[lo:hi]))
            counts.append(hi - lo)
            lo = hi
    return text[:at], parts, counts


def spans(parts: list[str], sizes: list[int]) -> tuple[list[int], list[int], list[bytes]]:
    """First part, number of parts and 128-bit hash of each span; case and the width of white space don't count."""
    plain = [" ".join(p.lower().split()) for p in parts]
    firsts, counts, hashes = [], [], []
    end, words, n = 0, 0, len(parts)
    for i in range(n):
        while end < n and (end - i < PARTS or words < WORDS):
            words += sizes[end]
            end += 1
        if end - i < PARTS or words < WORDS:
            break
        firsts.append(i)
        counts.append(end - i)
        hashes.append(xxhash.xxh3_128_digest(" ".join(plain[i:end]).encode("utf-8", "replace")))
        words -= sizes[i]
    return firsts, counts, hashes


#: Ids with several texts that are broadcast at most.
SHARED_IDS = 100_000
#: What tells documents apart: see ``identity``.
KEYS = ("_id", "_t1", "_t2")
SPANS = T.StructType([T.StructField(c, T.LongType()) for c in (*KEYS, "place", "h")])
#: A place is, from its lowest bits: the number of parts (at most WORDS, 4 bits), the first part (32), more of the span's hash (28).
N_BITS, FIRST_BITS = 4, 32


def span_table(docs: DataFrame) -> DataFrame:
    """A row for each span of ``docs`` (_id, _t1, _t2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [spans(*sentences(t)[1:]) if t else ([], [], []) for t in part.column("text").to_pylist()]
                of = np.repeat(np.arange(part.num_rows), [len(f[0]) for f in found])
                first, n = (np.array([x for f in found for x in f[k]], np.int64) for k in range(2))
                h = np.frombuffer(b"".join(x for f in found for x in f[2]), np.uint64).reshape(-1, 2)
                place = (h[:, 1] >> np.uint64(36) << np.uint64(N_BITS + FIRST_BITS)).view(np.int64) | first << N_BITS | n
                rows = pa.array(of)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in KEYS), pa.array(place), pa.array(h[:, 0].copy().view(np.int64))], names=SPANS.names)

    return docs.select(*KEYS, "text").mapInArrow(run, SPANS)


def identity(text: Column, doc_id: Column) -> list[Column]:
    """What tells documents apart: the id, which may be null, and 128 bits of hash of the text in two halves (null for null)."""
    return [doc_id.cast("long"), F.when(text.isNotNull(), F.xxhash64(text)), F.when(text.isNotNull(), F.xxhash64(F.lit(1), text))]


def same(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on ``columns``, nulls equal to nulls; the columns are left's."""
    other = right.select(*(F.col(f"`{c}`").alias(f"{c} of right") if c in columns else F.col(f"`{c}`") for c in right.columns))
    on = [F.col(f"`{c}`").eqNullSafe(F.col(f"`{c} of right`")) for c in columns]
    return left.join(other, on, how).drop(*(f"{c} of right" for c in columns))


def shorter_keys(keyed: DataFrame, own: list[str]) -> DataFrame:
    """``keyed`` with zeros for the hashes (columns ``own`` but the first) of documents whose id has no other text: an id is enough there.

    Spans carry a document's key, and zeros are shuffled for next to nothing. Where too many ids have several texts to be broadcast, all keep them.
    """
    key, *hashes = own
    differ = [F.min(c) != F.max(c) for c in hashes]
    shared = staged(keyed.select(*own).groupBy(key).agg((differ[0] | differ[1]).alias("several")).filter("several").select(key), "shared-ids")
    n = shared.limit(SHARED_IDS + 1).count()
    if n > SHARED_IDS:
        return keyed
    zero = {c: F.when(F.col(c).isNotNull(), F.lit(0).cast("long")) for c in hashes}
    if not n:
        return keyed.withColumns(zero)
    (flag,) = fresh(keyed.columns, "_several")
    marked = same(keyed, F.broadcast(shared.withColumn(flag, F.lit(True))), [key], "left")
    return marked.withColumns({c: F.when(F.col(flag), F.col(c)).otherwise(zero[c]) for c in hashes}).drop(flag)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeats taken out of ``text``, and ``n_removed``, the parts taken.

    The first occurrence of a span is the one in the smallest id (null first), then text digest, then place; within a document
    too. Parts outside repeated spans stay as they are, white space included; a text whose parts all
    go is empty, a null one stays null. Rows with equal id and text are one document: they are treated alike, and don't count
    as repeats of each other. Spans are one if 92 bits of the hashes of their words are: among n spans, n * n / 2**93 pairs
    are expected to be so by chance (one in 10,000 tables of 10**12). A column named ``n_removed`` is replaced; others stay, whatever their names.
    """
    kept = [c for c in docs.columns if c != "n_removed"]
    *own, marks = fresh(kept, *KEYS, "_spans")
    keyed = docs.select(*(F.col(f"`{c}`") for c in kept), *(x.alias(c) for c, x in zip(own, identity(F.col(f"`{text}`"), F.col(f"`{doc_id}`")), strict=True)))
    keyed = shorter_keys(keyed, own)
    found = staged(span_table(keyed.select(*(F.col(c).alias(k) for c, k in zip(own, KEYS, strict=True)), F.col(f"`{text}`").alias("text"))), "spans")
    # hashes alone are counted, before the shuffle, so a span that a third of the documents share is a row for each task; the
    # join back is to one row a span, so Spark can split the rows of such a span; places are shuffled with repeated spans only
    repeated = staged(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "repeated")
    several = staged(found.join(repeated, "h"), "several")
    more = F.shiftrightunsigned("place", N_BITS + FIRST_BITS)
    first = several.groupBy("h", more.alias("more")).agg(F.min(F.struct(*KEYS, "place")).alias("first"))
    first = staged(first, "firsts")
    again = ~F.struct(*KEYS, "place").eqNullSafe(F.col("first"))
    covered = several.withColumn("more", more).join(first, ["h", "more"]).filter(again).select(*(F.col(k).alias(c) for c, k in zip(own, KEYS, strict=True)), "place")
    covered = covered.groupBy(*own).agg(F.collect_set("place").alias(marks))
    joined = same(keyed, covered, own, "left").drop(*own)
    schema = T.StructType([*(f for f in joined.schema.fields if f.name != marks), T.StructField("n_removed", T.LongType())])

    def cut(t: str | None, marked: list[int] | None) -> tuple[str | None, int]:
        if t is None or not marked:
            return t, 0
        head, parts, _ = sentences(t)
        gone = np.zeros(len(parts) + 1, np.int64)
        for m in marked:
            at = m >> N_BITS & ((1 << FIRST_BITS) - 1)
            gone[at] += 1
            gone[at + (m & ((1 << N_BITS) - 1))] -= 1
        gone = gone.cumsum()[:-1] > 0
        left = [p for p, g in zip(parts, gone, strict=True) if not g]
        return (head + "".join(left)).rstrip() if left else "", int(gone.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out = [cut(t, m) for t, m in zip(part.column(text).to_pylist(), part.column(marks).to_pylist(), strict=True)]
                columns = [pa.array([t for t, _ in out], pa.string()) if c == text else part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in out], pa.int64())], names=[*kept, "n_removed"])

    return joined.mapInArrow(run, schema)

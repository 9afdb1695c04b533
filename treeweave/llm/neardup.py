"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Shingles of five words are counted by the documents that hold them, over all documents, in a table of 2**20 counters
   (a shingle's counter is its hash's top bits: its frequency is never counted too low, and too high by the
   others of its counter, which for rare shingles is about the same for all). The table's size is fixed, whatever the input's.
2. A shingle weighs its frequency in the document times its damped inverse document frequency, 1 + RARE * ln((n + 1) / (count + 1)) / ln(n + 2).
   Undamped, a text that thousands copy would have cheap shingles and its copies' edits dear ones: the more copies, the
   less alike. Improved consistent weighted sampling draws
   BANDS * ROWS samples from a document's weights; two documents' samples are equal with the probability of
   their weighted Jaccard similarity. ROWS samples hashed together are a band's key.
3. Texts with the same words are one node. In each band, nodes of one key are compared with one leader, chosen by a hash
   of the band and the node, and linked where the weighted Jaccard similarity, computed from all shingles, is SIMILAR or more.
4. Keys whose nodes aren't all connected by then get every missing comparison: those outside the key's largest component
   against all, block by block, as matrix products. So no candidate pair is left out, and a key that
   thousands of copies share costs one comparison for each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .components import components
from .shared import let_go, shuffle_partitions, staged
from .substrings import KEYS, identity, same

SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 12, 4
COUNTER_BITS, CHUNKS = 20, 64
#: How much more than the commonest shingle the rarest weighs.
RARE = 0.25
#: Nodes of a block in step 4.
BLOCK = 256


MULTIPLIER = 0x9E3779B97F4A7C15


def word_characters() -> np.ndarray:
    """Which code points belong to words: letters, digits and the underscore."""
    return np.array([chr(c).isalnum() or c == 95 for c in range(0x110000)], bool)


class Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, as far as they were needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, x in (("up", MULTIPLIER), ("down", pow(MULTIPLIER, -1, 1 << 64))):
                steps = np.full(n, x, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up[:n], cls.down


_WORD: list[np.ndarray] = []


def shingle_batch(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """For each text a digest of its words; and the sorted shingles of all, text number << 32 | 32-bit hash, repeats included.

    Words are runs of letters, digits and underscores, in lower case. A text of fewer words than SHINGLE is one shingle. All words are hashed at once: a
    word's hash is a difference of the running sum of characters times powers, divided by the power where it begins.
    """
    if not _WORD:
        _WORD.append(word_characters())
    low = [t.lower() if t else "" for t in texts]
    codes = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.cumsum([0, *(len(t) + 1 for t in low)])[:-1]
    edge = np.diff(np.concatenate([[False], _WORD[0][codes], [False]]).view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = Powers.upto(len(codes) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)])
    w = (total[end] - total[start]) * down[start]
    w = (w ^ (w >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    text = np.searchsorted(begins, start, "right") - 1
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    digests = [xxhash.xxh3_128_digest(w[a:b].tobytes()) for a, b in zip(cut, cut[1:], strict=False)]
    keys = np.empty(0, np.uint64)
    if len(w) >= SHINGLE:
        h = np.zeros(len(w) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            h = h * np.uint64(MULTIPLIER) + w[k : k + len(h)]
        whole = text[: len(h)] == text[SHINGLE - 1 :]
        keys = text[: len(h)][whole].astype(np.uint64) << np.uint64(32) | mixed(h[whole])
    short = [(i, np.uint64(0)) for i in np.flatnonzero((np.diff(cut) > 0) & (np.diff(cut) < SHINGLE))]
    if short:
        few = np.array([int(i) << 32 | xxhash.xxh32_intdigest(w[cut[i] : cut[i + 1]].tobytes()) for i, _ in short], np.uint64)
        keys = np.concatenate([keys, few])
    return digests, np.sort(keys)


def mixed(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(32)


def shingles(text: str | None) -> tuple[bytes, np.ndarray]:
    """One text's digest and its sorted 32-bit shingles."""
    digests, keys = shingle_batch([text])
    return digests[0], keys.astype(np.uint32)


def slices(batch: pa.RecordBatch, rows: int = 48, characters: int = 400_000) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of so many rows, fewer where texts are long."""
    sizes = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy()
    piece = np.maximum(np.arange(len(sizes)) // rows, np.cumsum(sizes) // characters)
    for first, last in zip(*(lambda f: (f, [*f[1:], len(sizes)]))(np.flatnonzero(np.diff(piece, prepend=-1))), strict=True):
        yield batch.slice(int(first), int(last - first))


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """How many documents of ``texts`` (text) each counter has met. Partial tables are summed chunk by chunk, on the way."""
    width = 1 << (COUNTER_BITS - CHUNKS.bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        table = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in batches:
            for part in slices(batch):
                keys = shingle_batch(part.column("text").to_pylist())[1]
                counters = (keys[np.diff(keys, prepend=np.uint64(2**64 - 1)) != 0] & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - COUNTER_BITS)
                np.add.at(table, counters, np.uint32(1))
        if table.any():
            parts = [c.astype(np.min_scalar_type(c.max())) for c in table.reshape(CHUNKS, width)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for x in batches:
            for chunk, counts in zip(x["chunk"], x["counts"], strict=True):
                part = np.frombuffer(counts, f"u{len(counts) // width}")
                sums[chunk] = sums.get(chunk, np.zeros(width, np.uint64)) + part
        yield pd.DataFrame({"chunk": [*sums], "counts": [s.astype(np.uint64).tobytes() for s in sums.values()]})

    schema = "chunk int, counts binary"
    # two steps: what one task adds up is bounded by tasks / salts, and then by the salts
    salts = 8
    parts = texts.select("text").mapInArrow(count, schema).withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(salts)))
    parts = parts.repartition(max(shuffle_partitions(texts.sparkSession), CHUNKS), "chunk", "salt").mapInPandas(add, schema)
    found = np.zeros((CHUNKS, width), np.uint64)
    for r in parts.repartition(CHUNKS, "chunk").mapInPandas(add, schema).collect():  # 2**20 counters of 8 bytes
        found[r["chunk"]] += np.frombuffer(r["counts"], np.uint64)
    return found.ravel()


def sampling_tables() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) variates by 16 bits of hash, and the logarithms of others."""
    rng = np.random.default_rng(4)
    return rng.gamma(2, 1, 1 << 16).astype(np.float32), np.log(rng.gamma(2, 1, 1 << 16)).astype(np.float32)


GAMMA, LOG_GAMMA = sampling_tables()
PER_GAMMA = (1 / GAMMA).astype(np.float32)


def consistent_samples(shingle: np.ndarray, log_weight: np.ndarray, first: np.ndarray, samples: int) -> np.ndarray:
    """Sample k of each set: (sets by samples) hashes of the drawn shingle and its level. ``first``: where the sets begin; none is empty."""
    sizes = np.diff(np.append(first, len(shingle)))
    out = np.empty((len(first), samples), np.uint64)
    for k in range(samples):
        v = (shingle ^ np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32((k * 0x85EBCA6B + 0xC2B2AE35 & 0xFFFFFFFF) | 1)
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        a = v >> np.uint32(16)
        r = GAMMA[a]
        beta = (v & np.uint32(0xFFFF)).astype(np.float32) * np.float32(2**-16)
        level = np.floor(log_weight * PER_GAMMA[a] + beta)
        rank = LOG_GAMMA[(v * np.uint32(0x297A2D39)) >> np.uint32(16)] - r * (level - beta + 1)
        least = np.minimum.reduceat(rank, first)
        at = np.flatnonzero(rank == np.repeat(least, sizes))
        at = at[np.searchsorted(at, first)]  # of equal ranks the smallest shingle
        out[:, k] = (shingle[at].astype(np.uint64) << np.uint64(32)) ^ level[at].astype(np.int64).astype(np.uint64)
    return out


def shingle_weights(counts: np.ndarray, n: float) -> np.ndarray:
    """The weight that one occurrence of a shingle has, by counter: 1 for one that all documents hold, up to 1 + RARE."""
    rare = np.log((n + 1) / (np.minimum(counts, n) + 1.0)) / np.log(n + 2)
    return (1 + RARE * rare).astype(np.float32)


def weights_of(shingle: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return idf[shingle >> np.uint32(32 - COUNTER_BITS)]


SKETCH = T.StructType([*(T.StructField(c, T.LongType()) for c in KEYS), T.StructField("c", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def sketches(keyed: DataFrame, idf) -> DataFrame:
    """For each row of ``keyed`` (_id, _t1, _t2, text): the digest of its words and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = np.random.default_rng(44).integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            for part in slices(batch):
                digests, keys = shingle_batch(part.column("text").to_pylist())
                bands = np.zeros((len(digests), BANDS), np.uint64)
                some: np.ndarray = np.empty(0, np.int64)
                if len(keys):
                    at = np.flatnonzero(np.diff(keys, prepend=np.uint64(2**64 - 1)))
                    flat, text = keys[at].astype(np.uint32), (keys[at] >> np.uint64(32)).astype(np.int64)
                    log_weight = np.log(weights_of(flat, idf.value) * np.diff(at, append=len(keys))).astype(np.float32)
                    first = np.flatnonzero(np.diff(text, prepend=-1))
                    some = text[first]
                    drawn = consistent_samples(flat, log_weight, first, BANDS * ROWS).reshape(len(some), BANDS, ROWS)
                    drawn = (drawn ^ (drawn >> np.uint64(29))) * mix
                    bands[some] = np.bitwise_xor.reduce(drawn ^ (drawn >> np.uint64(32)), axis=2)
                none = np.ones(len(digests), bool)
                none[some] = False
                ends = pa.array(np.arange(len(digests) + 1) * BANDS, pa.int32(), mask=np.append(none, False))
                lists = pa.ListArray.from_arrays(ends, pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in KEYS), pa.array(digests, pa.binary()), lists], names=SKETCH.names)

    return keyed.select(*KEYS, "text").mapInArrow(run, SKETCH)


def shingle_table(texts: DataFrame) -> DataFrame:
    """(c, s): a text's digest and its shingles as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                digests, keys = shingle_batch(part.column("text").to_pylist())
                cut = np.searchsorted(keys >> np.uint64(32), np.arange(len(digests) + 1))
                own = [keys[a:b].astype("<u4").tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(own, pa.binary())], names=["c", "s"])

    return texts.select("text").mapInArrow(run, "c binary, s binary")


def occurrences(s: np.ndarray) -> np.ndarray:
    """Sorted shingles with the number of the repeat in the low bits: as a set what they were as a multiset."""
    at = np.arange(len(s))
    first = np.maximum.accumulate(np.where(np.append(True, s[1:] != s[:-1]), at, 0)) if len(s) else at
    return s.astype(np.uint64) << np.uint64(24) | (at - first).astype(np.uint64)


def similarity(a: np.ndarray, b: np.ndarray, idf: np.ndarray) -> float:
    """Weighted Jaccard of two texts' sorted shingles: the lesser weights' sum over the greater ones'."""
    x, y = occurrences(a), occurrences(b)
    both = np.intersect1d(x, y, assume_unique=True)
    shared = float(weights_of((both >> np.uint64(24)).astype(np.uint32), idf).sum(dtype=np.float64))
    whole = float(weights_of(a, idf).sum(dtype=np.float64) + weights_of(b, idf).sum(dtype=np.float64)) - shared
    return shared / whole if whole else 0.0


def block_links(sets: list[np.ndarray], component: list[bytes], outer: np.ndarray, idf: np.ndarray) -> list[tuple[int, int]]:
    """Links that join different components, as few as join them: between ``outer`` rows and all."""
    rows = np.flatnonzero(outer)
    if len(sets) <= 12:
        return forest(((i, j) for i in rows for j in range(len(sets)) if j != i and not (outer[j] and j < i)), sets, component, idf)
    items = [occurrences(s) for s in sets]
    flat = np.concatenate(items)
    owner = np.repeat(np.arange(len(sets)), [len(i) for i in items])
    weight = np.bincount(owner, weights_of((flat >> np.uint64(24)).astype(np.uint32), idf), len(sets))
    values, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    use = count[column] > 1
    shared = np.zeros((len(rows), len(sets)))
    w = np.sqrt(weights_of((values[count > 1] >> np.uint64(24)).astype(np.uint32), idf))
    o, c = owner[use], number[column[use]]
    for lo in range(0, len(w), 8192):  # columns in slices, so that the matrix stays small
        part = (c >= lo) & (c < lo + 8192)
        m = np.zeros((len(sets), min(8192, len(w) - lo)), np.float32)
        m[o[part], c[part] - lo] = w[c[part]]
        shared += m[rows] @ m.T
    similar = shared >= (SIMILAR - 1e-4) * (weight[rows][:, None] + weight - shared)
    return forest(((rows[i], j) for i, j in zip(*np.nonzero(similar), strict=True)), sets, component, idf)


def forest(pairs: Iterable[tuple[int, int]], sets: list[np.ndarray], component: list[bytes], idf: np.ndarray) -> list[tuple[int, int]]:
    """Those of ``pairs`` that are similar and connect what wasn't connected by then."""
    root = {c: c for c in component}

    def find(c: bytes) -> bytes:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for i, j in pairs:
        a, b = find(component[i]), find(component[j])
        if a != b and similarity(sets[i], sets[j], idf) >= SIMILAR:
            root[max(a, b)] = min(a, b)
            out.append((int(i), int(j)))
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's class: _id, _t1, _t2 (see ``identity``), class_id (the class's smallest id), copies (rows of the class), kept.

    Documents are linked from a weighted Jaccard similarity of SIMILAR on; a class is what links connect. Texts with the
    same words in the same order are always in one class; null texts and texts without words count as equal. ``kept``
    marks one id and text of each class, the smallest; rows repeated whole are all marked alike. A null id stays null and comes before all others.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").alias("doc_id"))
    keyed = keyed.select(*(x.alias(c) for c, x in zip(KEYS, identity(F.col("text"), F.col("doc_id")), strict=True)), "text")
    counts = document_frequencies(keyed)
    n = float(keyed.count())
    idf = spark.sparkContext.broadcast(shingle_weights(counts, n))
    rows = staged(sketches(keyed, idf), "sketches")
    nodes = staged(rows.groupBy("c").agg(F.min(F.struct(*KEYS)).alias("rep"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n")), "nodes")

    members = nodes.filter("bands IS NOT NULL").select("c", F.posexplode("bands").alias("band", "key"))
    leader = F.min(F.struct(F.xxhash64("band", "c").alias("h"), "c"))
    buckets = staged(members.groupBy("band", "key").agg(leader.alias("l"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("band", "key", F.col("l.c").alias("leader")), "buckets")
    shared = staged(members.join(buckets, ["band", "key"]), "shared")
    pairs = staged(shared.filter(F.col("c") != F.col("leader")).select("c", "leader").distinct(), "pairs")

    ids = nodes.join(shared.select("c").distinct(), "c", "left_semi").select("rep.*")
    sets = staged(shingle_table(same(keyed, ids, [*KEYS], "left_semi")).groupBy("c").agg(F.first("s").alias("s")), "sets")
    compared = pairs.join(sets.select(F.col("c").alias("leader"), F.col("s").alias("sl")), "leader").join(sets, "c")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("s"), batch.column("sl"), strict=True)
            same = [similarity(np.frombuffer(a.as_py(), "<u4"), np.frombuffer(b.as_py(), "<u4"), idf.value) >= SIMILAR for a, b in both]
            part = batch.filter(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column("c"), part.column("leader")], names=["a", "b"])

    links = staged(compared.select("c", "leader", "s", "sl").mapInArrow(verify, "a binary, b binary"), "leader-links")
    joined = components(links)
    rest = missing_comparisons(shared, joined, sets, idf)
    more = staged(rest, "block-links")
    if more.limit(1).count():
        joined = components(links.unionByName(more))
    classes = nodes.join(joined.withColumnRenamed("node", "c"), "c", "left").select("c", "rep", "n", F.coalesce("root", "c").alias("root"))
    classes = staged(classes, "classes")
    named = staged(classes.groupBy("root").agg(F.min("rep").alias("first"), F.sum("n").alias("copies")), "named")
    classes = staged(classes.select("c", "root").join(named, "root").select("c", "first", "copies"), "classes")
    out = rows.select(*KEYS, "c").join(classes, "c")
    kept = F.struct(*KEYS).eqNullSafe(F.col("first"))
    return out.select(*KEYS, F.col("first._id").alias("class_id"), "copies", kept.alias("kept"))


def missing_comparisons(shared: DataFrame, joined: DataFrame, sets: DataFrame, idf) -> DataFrame:
    """Links (a, b) between the components that meet in a bucket: nodes outside its largest component against all."""
    rest = shared.filter(F.col("c") != F.col("leader")).select("c", "band", "key")  # leaders have met all others
    placed = staged(rest.join(joined.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c")), "placed")
    sizes = placed.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("c")).alias("x"))
    split = sizes.groupBy("band", "key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"), F.bit_xor("x").alias("x"))
    split = split.filter("parts > 1").groupBy("x", "all").agg(F.min_by(F.struct("band", "key", "most"), F.struct("band", "key")).alias("b"))  # bands with the same nodes: once
    split = split.select("b.band", "b.key", F.col("b.most.root").alias("most"), F.col("b.most.n").alias("n_in"), (F.col("all") - F.col("b.most.n")).alias("n_out"))
    split = staged(split, "split")
    some = placed.join(split, ["band", "key"]).withColumn("outer", F.col("root") != F.col("most"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    number = F.when(F.col("outer"), F.pmod(F.xxhash64("c"), blocks("n_out"))).otherwise(F.pmod(F.xxhash64("c"), blocks("n_in")) + blocks("n_out")).cast("int")
    some = some.withColumn("mine", number)
    others = F.sequence(F.lit(0), blocks("n_out") - 1)
    every = F.sequence(F.lit(0), blocks("n_out") + blocks("n_in") - 1)
    some = some.withColumn("with", F.explode(F.when(F.col("outer"), every).otherwise(others)))
    some = some.select("band", "key", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "c", "root", "outer").join(sets, "c")

    def compare(x: pd.DataFrame) -> pd.DataFrame:
        x = x.drop_duplicates("c")
        found = []
        if x["outer"].any() and x["root"].nunique() > 1:
            found = block_links([np.frombuffer(s, "<u4") for s in x["s"]], [*x["root"]], x["outer"].to_numpy(bool), idf.value)
        c = [*x["c"]]
        return pd.DataFrame({"a": [c[i] for i, _ in found], "b": [c[j] for _, j in found]})

    return some.groupBy("band", "key", "i", "j").applyInPandas(compare, "a binary, b binary")

"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes, over a whole corpus.

Byte offsets where tokens of both sides end cut a text into groups; a pair of tokens of one group is a link. How many
documents hold a pair of ids is counted in dense matrices: the first side's ids are dealt out to stripes, and a task adds the pairs of
one stripe after the other into a block of (ids of the stripe, ids of the second side). A block's row maxima tell the best partners.

Links never travel one by one. A block of documents keeps, for each stripe, three packed arrays: document, pair and how often the
document holds the pair. These rows meet their stripe's counts where the counts are, and come back as sums for each document.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import held, shuffle_partitions, staged

#: Bytes of a stripe's dense block of 64-bit counts, at most.
BLOCK_BYTES = 1 << 26
#: Characters of text, and documents, of a block of documents.
BLOCK_TEXT, BLOCK_DOCS = 8_000_000, 8192
#: Characters that are looked up at a time.
SLICE = 1_000_000
#: Bytes, about, of what a Python worker remembers of chunks.
REMEMBERED = 150_000_000
#: Blocks of documents whose rows of one stripe a task scores; more are dealt out to as many tasks as it takes.
SALTED = 256
#: Cells of a row of counts, and pairs that a task holds before it hands them on.
CELLS, PENDING = 500_000, 4_000_000
#: Pairs of a group that are written out one by one; in larger groups equal ids are counted first.
PLAIN_GROUP = 4096

#: Where a text may be cut: neither side has a token that reaches from another character over a single space. The space goes with what follows.
CUT = re.compile(r"(?<=[!-~\w]) (?=.)", re.DOTALL)

STAGED = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("stripe", T.IntegerType()),
        T.StructField("docs", T.BinaryType()),
        T.StructField("cells", T.BinaryType()),
        T.StructField("times", T.BinaryType()),
        T.StructField("place", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")),
        T.StructField("groups_sha256", T.StringType()),
    ]
)


def byte_level() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Sides:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        written = byte_level()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(written[c] for c in t) if all(c in written for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.n_a, self.n_b = len(self.a_bytes), len(self.b_bytes)
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [x.ids for x in self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)], self.b.encode(chunks, num_threads=1)


def vocabulary_sizes(a_path: str, b_path: str) -> tuple[int, int]:
    """How many ids either side has; read on the driver, from the files."""
    import sentencepiece

    with open(a_path, encoding="utf-8") as f:
        spec = json.load(f)
    highest = max(chain(spec["model"]["vocab"].values(), (t["id"] for t in spec["added_tokens"])))
    return highest + 1, sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of ``counts``, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``keys``, ascending, and the sums of their ``times``."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(times[order], first) if len(first) else times[:0]


class Chunks:
    """What a Python worker knows of chunks of text: counts, groups as text, and distinct pairs with their number."""

    def __init__(self, a_path: str, b_path: str):
        self.sides = s = Sides(a_path, b_path)
        self.a_len = np.array([len(x) for x in s.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in s.b_bytes], np.int64)
        self.written = [f"{sep}{i}" for n, seps in ((s.n_a, ";,"), (s.n_b, "|,")) for sep in seps for i in range(n)]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.bytes = 0
        self.counts = np.empty((0, 5), np.int64)  # tokens of a, of b, groups, links, and 1 where the bytes don't agree
        self.starts = np.zeros(1, np.int64)
        self.pairs, self.times = np.empty(0, np.uint32), np.empty(0, np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Enter new chunks."""
        s, n = self.sides, len(chunks)
        a_ids, b_ids = s.encode(chunks)
        counts = np.zeros((n, 5), np.int64)
        good = []
        for k, (c, a, b) in enumerate(zip(chunks, a_ids, b_ids, strict=True)):
            whole = (" " + c).encode()
            if b"".join([s.a_bytes[i] for i in a]) == whole == b"".join([s.b_bytes[i] for i in b]):
                good.append(k)
            else:
                counts[k, 4] = 1
        owner = np.array(good, np.int64)
        a = np.array([*chain.from_iterable(a_ids[k] for k in good)], np.int64)
        b = np.array([*chain.from_iterable(b_ids[k] for k in good)], np.int64)
        counts[owner, 0], counts[owner, 1] = [len(a_ids[k]) for k in good], [len(b_ids[k]) for k in good]
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        n_a, n_b = np.bincount(a_group, minlength=len(ends)), np.bincount(b_group, minlength=len(ends))
        chunk = np.zeros(len(ends), np.int64)
        chunk[a_group] = np.repeat(owner, counts[owner, 0])
        counts[:, 2] = np.bincount(chunk, minlength=n)
        np.add.at(counts[:, 3], chunk, n_a * n_b)
        plain = n_a * n_b <= PLAIN_GROUP
        b_start = np.cumsum(n_b) - n_b
        on = plain[a_group]
        times = n_b[a_group[on]]
        left = np.repeat(a[on], times)
        right = b[runs(times) + np.repeat(b_start[a_group[on]], times)]
        found = [(np.repeat(chunk[a_group[on]], times) << 32) | (left * s.n_b + right)]
        weights = [np.ones(len(left), np.int64)]
        for g in np.flatnonzero(~plain):
            x, xn = np.unique(a[a_group == g], return_counts=True)
            y, yn = np.unique(b[b_start[g] : b_start[g] + n_b[g]], return_counts=True)
            found.append((chunk[g] << 32) | (x[:, None] * s.n_b + y).ravel())
            weights.append((xn[:, None] * yn).ravel())
        keys, times = summed(np.concatenate(found), np.concatenate(weights))
        # tokens of a group's first side, then of its second, group after group
        a_at = np.arange(len(a)) + b_start[a_group]
        b_at = np.arange(len(b)) + np.cumsum(n_a)[b_group]
        symbols = np.empty(len(a) + len(b), np.int64)
        symbols[a_at] = np.where(np.diff(a_group, prepend=-1) > 0, a, a + s.n_a)
        symbols[b_at] = np.where(np.diff(b_group, prepend=-1) > 0, b, b + s.n_b) + 2 * s.n_a
        texts, written, at = symbols.tolist(), self.written, 0
        groups = [""] * n
        for k in good:
            to = at + len(a_ids[k]) + len(b_ids[k])
            groups[k] = "".join([written[i] for i in texts[at:to]])
            at = to
        self.number |= zip(chunks, range(len(self.groups), len(self.groups) + n), strict=True)
        self.groups += groups
        self.counts = np.concatenate([self.counts, counts])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.bincount(keys >> 32, minlength=n))])
        self.pairs = np.concatenate([self.pairs, (keys & 0xFFFFFFFF).astype(np.uint32)])
        self.times = np.concatenate([self.times, times])
        self.bytes += sum(map(len, chunks)) + sum(map(len, groups)) + 250 * n + 12 * len(keys)

    def look_up(self, parts: list[list[str]]) -> list[np.ndarray]:
        """The numbers of the chunks of each part."""
        if self.bytes > REMEMBERED:
            self.forget()
        new = [*dict.fromkeys(c for p in parts for c in p if c not in self.number)]
        if new:
            self.learn(new)
        number = self.number.__getitem__
        return [np.fromiter(map(number, p), np.int64, len(p)) for p in parts]


def cut(text: str, cuts: bool) -> Iterator[list[str]]:
    """A text in chunks, by about SLICE characters; each chunk stands for itself with a space before it."""
    at = 0
    while True:
        m = CUT.search(text, at + SLICE) if cuts and len(text) > at + SLICE else None
        part = text[at : m.start()] if m else text[at:]
        yield CUT.split(part) if cuts else [part]
        if not m:
            return
        at = m.end()


class DocumentBlock:
    """Documents whose links are packed together."""

    def __init__(self, known: Chunks):
        self.known = known
        self.ids: list[int | None] = []
        self.counts: list[np.ndarray] = []
        self.digests: list[str] = []
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting: list[tuple[int, list[str]]] = []
        self.size = self.held = 0
        self.digest = hashlib.sha256()

    def add(self, doc_id: int | None, text: str | None) -> None:
        place = len(self.ids)
        self.ids.append(doc_id)
        self.counts.append(np.zeros(5, np.int64))
        self.digests.append("")
        if not text:
            return
        self.size += len(text)
        if len(text) <= SLICE:
            self.held += len(text)
            self.waiting.append((place, next(cut(text, self.known.sides.cuts))))
            if self.held >= SLICE:
                self.settle()
            return
        self.settle()
        digest, first, found = hashlib.sha256(), True, []
        for chunks in cut(text, self.known.sides.cuts):
            written = self.count(place, self.known.look_up([chunks])[0], found)
            digest.update(written[1:].encode() if first else written.encode())
            first = False
        self.close(place, digest.hexdigest(), found)

    def count(self, place: int, numbers: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> str:
        """Add a document's chunks; returns its groups as text."""
        k = self.known
        self.counts[place] += k.counts[numbers].sum(axis=0)
        distinct, often = np.unique(numbers, return_counts=True)
        sizes = k.starts[distinct + 1] - k.starts[distinct]
        at = runs(sizes) + np.repeat(k.starts[distinct], sizes)
        found.append(((np.int64(place) << 32) | k.pairs[at].astype(np.int64), k.times[at] * np.repeat(often, sizes)))
        return "".join([k.groups[i] for i in numbers.tolist()])

    def close(self, place: int, digest: str, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        if self.counts[place][4]:
            self.counts[place][:] = 0
        else:
            self.digests[place] = digest
            self.found += found if len(found) < 2 else [summed(*map(np.concatenate, zip(*found, strict=True)))]

    def settle(self) -> None:
        """Count the documents that wait."""
        for (place, _), numbers in zip(self.waiting, self.known.look_up([c for _, c in self.waiting]), strict=True):
            found: list[tuple[np.ndarray, np.ndarray]] = []
            written = self.count(place, numbers, found)
            self.close(place, hashlib.sha256(written[1:].encode()).hexdigest(), found)
        self.waiting, self.held = [], 0

    def rows(self, block: int, stripes: int) -> pa.RecordBatch:
        """A row for each document, and one for each stripe with links."""
        self.settle()
        n_b = self.known.sides.n_b
        keys, times = summed(*map(np.concatenate, zip(*self.found, strict=True))) if self.found else (np.empty(0, np.int64), np.empty(0, np.int64))
        a, b = np.divmod(keys & 0xFFFFFFFF, n_b)
        stripe = (a % stripes).astype(np.int16)
        order = np.argsort(stripe, kind="stable")
        docs, cells, times = (keys >> 32)[order].astype("<u2"), (a // stripes * n_b + b)[order].astype("<u4"), times[order]
        bounds = np.searchsorted(stripe[order], np.arange(stripes + 1))
        present = np.flatnonzero(np.diff(bounds))
        n, m = len(self.ids), len(present)
        spans = [slice(bounds[s], bounds[s + 1]) for s in present]
        counts = np.array(self.counts).reshape(n, 5)

        def of_docs(values: list, kind: pa.DataType) -> pa.Array:
            return pa.array([*values, *[None] * m], kind)

        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + m, block)),
                pa.array([*[None] * n, *present.tolist()], pa.int32()),
                pa.array([*[None] * n, *(docs[x].tobytes() for x in spans)], pa.binary()),
                pa.array([*[None] * n, *(cells[x].tobytes() for x in spans)], pa.binary()),
                pa.array([*[None] * n, *(packed(times[x]) for x in spans)], pa.binary()),
                of_docs([*range(n)], pa.int32()),
                of_docs(self.ids, pa.int64()),
                *(of_docs(counts[:, c].tolist(), pa.int64()) for c in range(4)),
                of_docs(self.digests, pa.string()),
            ],
            names=STAGED.names,
        )


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold the largest; the first byte tells how many."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(values) or int(values.max()) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def document_links(docs: DataFrame, a_path: str, b_path: str, stripes: int) -> DataFrame:
    """STAGED rows of ``docs`` (doc_id, text): one for each document, and one for each (block of documents, stripe)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held(("align", a_path, b_path), lambda: Chunks(a_path, b_path))
        task = TaskContext.get().partitionId() << 32
        block = DocumentBlock(known)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for doc_id, text in zip(ids, texts, strict=True):
                block.add(doc_id, text.as_py())
                if block.size >= BLOCK_TEXT or len(block.ids) >= BLOCK_DOCS:
                    yield block.rows(task, stripes)
                    task, block = task + 1, DocumentBlock(known)
        if block.ids:
            yield block.rows(task, stripes)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, STAGED)


def pair_counts(links: DataFrame, stripes: int, rows: int, n_b: int) -> DataFrame:
    """(stripe, cells, times): how many documents hold each pair, cells without any left out.

    A task first adds up its own documents' pairs; then each stripe's sums meet in one dense block.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def hand_on() -> pa.RecordBatch:
            sums = {s: summed(*map(np.concatenate, zip(*found, strict=True))) for s, found in waiting.items()}
            waiting.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([*sums], pa.int32()), pa.array([c.astype("<u4").tobytes() for c, _ in sums.values()], pa.binary()), pa.array([packed(t) for _, t in sums.values()], pa.binary())],
                names=["stripe", "cells", "times"],
            )

        for batch in batches:
            for s, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.unique(np.frombuffer(cells, "<u4"), return_counts=True)
                waiting.setdefault(s, []).append(found)
                size += len(found[0])
            if size > PENDING:
                yield hand_on()
                size = 0
        if waiting:
            yield hand_on()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now = np.zeros(rows * n_b, np.int64), None

        def written() -> Iterator[pa.RecordBatch]:
            cells = np.flatnonzero(block)
            for at in range(0, len(cells), CELLS):
                part = cells[at : at + CELLS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([now], pa.int32()), pa.array([part.astype("<u4").tobytes()], pa.binary()), pa.array([packed(block[part])], pa.binary())], names=["stripe", "cells", "times"]
                )
            block[cells] = 0

        for batch in batches:
            for s, cells, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != now:
                    if now is not None:
                        yield from written()
                    now = s
                np.add.at(block, np.frombuffer(cells, "<u4"), unpacked(times))
        if now is not None:
            yield from written()

    schema = "stripe int, cells binary, times binary"
    partial = links.select("stripe", "cells").mapInArrow(own, schema)
    return partial.repartition(min(stripes, 4 * shuffle_partitions(links.sparkSession)), "stripe").sortWithinPartitions("stripe").mapInArrow(add, schema)


def link_scores(links: DataFrame, counts: DataFrame, blocks: int, stripes: int, rows: int, n_b: int) -> DataFrame:
    """(block, docs, n_best, count_sum): packed sums for the documents of a block that have links in a stripe.

    Links go where their stripe's counts are. Where there are many blocks of documents, a stripe's links are dealt out to several tasks, each
    with the stripe's counts.
    """
    spark = links.sparkSession
    salts = -(-blocks // SALTED) or 1
    dealt = links.select("stripe", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), "block", "docs", "cells", "times")
    none = F.lit(None)
    known = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), none.cast("long").alias("block"), none.cast("binary").alias("docs"), "cells", "times")
    both = known.unionByName(dealt).repartition(min(stripes * salts, 4 * shuffle_partitions(spark)), "stripe", "salt").sortWithinPartitions("stripe", "salt", F.asc_nulls_first("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, now = np.zeros((rows, n_b), np.int64), np.zeros(rows, np.int64), None
        flat = block.reshape(-1)
        for batch in batches:
            out: list[tuple[int, bytes, bytes, bytes]] = []
            for s, salt, of, docs, cells, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (s, salt) != now:
                    flat[:] = 0
                    now, ready = (s, salt), False
                at = np.frombuffer(cells, "<u4")
                if of is None:
                    flat[at] = unpacked(times)
                    continue
                if not ready:
                    best, ready = block.max(axis=1), True
                found, weight = flat[at], unpacked(times)
                place, index = np.unique(np.frombuffer(docs, "<u2"), return_inverse=True)
                n_best, total = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
                np.add.at(n_best, index, weight * (found == best[at // n_b]))
                np.add.at(total, index, weight * found)
                out.append((of, place.tobytes(), packed(n_best), packed(total)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[k] for r in out], pa.binary()) for k in (1, 2, 3))], names=["block", "docs", "n_best", "count_sum"])

    return both.mapInArrow(run, "block long, docs binary, n_best binary, count_sum binary")


RESULT = T.StructType(
    [*(T.StructField(c, T.LongType()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())]
)


def documents_with_scores(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """RESULT: each document's row with the sums of all stripes."""
    none = F.lit(None)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = {f.name: f.dataType for f in STAGED.fields}
    own = rows.select("block", "place", *columns, *(none.cast("binary").alias(c) for c in ("docs", "n_best", "count_sum")))
    sums = scores.select("block", none.cast("int").alias("place"), *(none.cast(kinds[c]).alias(c) for c in columns), "docs", "n_best", "count_sum")
    both = own.unionByName(sums).repartition(shuffle_partitions(rows.sparkSession), "block").sortWithinPartitions("block", F.asc_nulls_last("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, sums_ = None, [], np.zeros((2, BLOCK_DOCS), np.int64)

        def written() -> pa.RecordBatch:
            n = len(kept)
            own_ = list(zip(*kept, strict=True))
            out = pa.RecordBatch.from_arrays(
                [*(pa.array(own_[k], pa.int64()) for k in range(5)), *(pa.array(s[:n].copy()) for s in sums_), pa.array(own_[5], pa.string())], names=RESULT.names
            )
            kept.clear()
            sums_[:] = 0
            return out

        for batch in batches:
            for of, place, *own_, docs, n_best, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != now:
                    if kept:
                        yield written()
                    now = of
                if place is not None:
                    kept.append(own_)
                    continue
                at = np.frombuffer(docs, "<u2")
                sums_[0, at] += unpacked(n_best)
                sums_[1, at] += unpacked(total)
        if kept:
            yield written()

    return both.mapInArrow(run, RESULT)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Align two tokenizers over ``docs`` (doc_id, text): a byte-level vocabulary (``a_path``) and a sentencepiece model (``b_path``).

    Returns a row for each row of ``docs``: doc_id, n_a and n_b (tokens), n_groups, n_links (pairs of tokens of one group), n_best (links whose
    pair is held by as many documents as any pair of its first id, over all of ``docs``), count_sum (documents that hold a link's pair,
    summed over links), groups_sha256 (digest of the groups' ids as ``a1,a2|b1;a3|b2``). A null or empty text, and one whose tokens on either side don't spell
    a space and the text, has no tokens: zeros, an empty digest, and no say in the counts. Repeated rows count each. Columns other than
    the two are not looked at. Memory: a stripe's block, a block of documents, and the longest stretch of a text without a place to cut it.
    """
    n_a, n_b = vocabulary_sizes(a_path, b_path)
    if n_a * n_b > 1 << 32:
        raise ValueError("pairs of ids must fit into 32 bits")
    stripes = max(1, -(-n_a * n_b * 8 // BLOCK_BYTES))
    rows = -(-n_a // stripes)
    found = staged(document_links(docs, a_path, b_path, stripes), "links")
    links, own = found.filter("stripe IS NOT NULL"), found.filter("stripe IS NULL")
    counts = staged(pair_counts(links, stripes, rows, n_b), "pair-counts")
    blocks = own.filter("place = 0").count()
    return documents_with_scores(own, link_scores(links, counts, blocks, stripes, rows, n_b))

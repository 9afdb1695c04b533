"""Tokenization and packing against the tokenizers library and exact bookkeeping."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from treeweave.llm import bpe, packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " \t\n", "  a  b", "ΑΣ ΟΔΟΣ Σ", "İstanbul", "<|endoftext|>hello <|startoftext|> X<|ENDOFTEXT|>", "aaaaaaaaaaaaaaa aaaaaaa", "école école ́x", "it's I'LL 'sx we'd '", "\x1c a\x1db c​d",
    "日本語 テキスト", "🙂🙂👍🏽 ok!!!...", "½ ² Ⅷ 123 ٣", "x" * 3000, "ﬁ ŉ ẞ ß ª º µ", "a\x85b\xa0c", "naïve ÿ Ā ɐ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_automaton_spells_as_the_library(library):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aeinrtsho lmd'éß.0<|>\n") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    encoder = bpe.Encoder(PATH)
    texts += ["".join(chr(0x4E00 + rng.randrange(500)) for _ in range(20_000))]  # one word
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_words_alone_and_together():
    rng = random.Random(2)
    automaton = bpe.Automaton(PATH)
    words = ["".join(rng.choice("aeinrtshoulmdéß!") for _ in range(rng.randint(1, 40))).encode() for _ in range(500)]
    assert [np.frombuffer(p, "<u4").tolist() for p in automaton.words(words)] == [automaton.word(w) for w in words]


def test_remembered_words_have_a_bound(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 190 * 40)
    encoder, rng = bpe.Encoder(PATH), random.Random(3)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abc") for _ in range(3)) for _ in range(12)) for _ in range(3)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.number) < 120


def test_long_words_count_by_their_bytes(library, monkeypatch):
    """What words take that are longer than usual, and their ids, is bounded as well."""
    monkeypatch.setattr(bpe, "REMEMBERED", 1_000_000)
    encoder, rng = bpe.Encoder(PATH), random.Random(4)
    for _ in range(40):
        texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(150)) for _ in range(40)) for _ in range(3)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert sum(map(len, encoder.number)) + encoder.ids.nbytes < 1_000_000 + 120 * 4 * 180


def test_gadgets_in_order():
    """Few merges, by hand: of a a a the left pair joins; a later merge doesn't take what an earlier one has."""
    a = bpe.Automaton.__new__(bpe.Automaton)
    vocab = {"a": 0, "b": 1, "aa": 2, "ab": 3}
    a.end, a._cut = "", {}
    a.met, a.free = np.full(16, -1, np.int64), np.zeros(16, bool)
    a._compile(vocab, [(0, 0, 2), (0, 1, 3)])
    a._spell(vocab)
    words, paths = [b"aaa", b"aab", b"aaab", b"ba", b"b"], [[2, 0], [2, 1], [2, 3], [1, 0], [1]]
    assert [a.word(w) for w in words] == paths
    assert [np.frombuffer(p, "<u4").tolist() for p in a.words(words)] == paths
    assert len(a.parent) == 3  # a state for each gadget beside the first


def test_encode_and_decode(spark, library):
    rows = [(i, t, "x") for i, t in enumerate([*ODD, None])] + [(0, ODD[0], "x"), (None, "null id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(docs, PATH), PATH).withColumn("sha", bpe.ids_digest(F.col("ids"))).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert r["sha"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_encode_and_decode_in_one_pass(spark, library):
    """As one after the other, with one Python worker a task; the decoded text may stand in the text's place, among columns of any order."""
    docs = spark.createDataFrame([(t, i, "x") for i, t in enumerate([*ODD, None, ODD[5]])] + [("null id", None, None)], "text string, doc_id long, more string")
    got = bpe.encode(docs, PATH, decoded="text")
    assert got.columns == ["doc_id", "more", "ids", "text"]
    want = bpe.decode(bpe.encode(docs, PATH), PATH).select("doc_id", "more", "ids", F.col("decoded").alias("text"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    beside = bpe.encode(docs, PATH, decoded="decoded")
    assert beside.columns == ["text", "doc_id", "more", "ids", "decoded"]
    for r in beside.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    found = bpe.encode(docs, PATH, ids="text")  # ids in the text's place
    assert sorted(map(str, found.collect())) == sorted(map(str, want.select("doc_id", "more", F.col("ids").alias("text")).collect()))


def test_one_python_worker_a_task(spark):
    """Encoding and decoding by workers of their own took an executor of two cores beyond 3000 MB."""
    plan = queries.op2_bpe_automaton(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_labels_of_lists():
    labels = pa.array(["a", None, "c", None], pa.string())
    ids = pa.array([[2, 0], [0], None, [], [0, 1, 2, 3, 9, -1], [None, 0]], pa.list_(pa.int32()))
    assert bpe.texts_of(ids, labels).to_pylist() == ["c a", "a", "", "", "a c", "a"]
    assert bpe.texts_of(ids.slice(1, 4), labels).to_pylist() == ["a", "", "", "a c"]
    assert bpe.texts_of(ids[:0], labels).to_pylist() == []
    for path in (PATH, public_tokenizers.path("byte_bpe_50k.json")):
        assert bpe.labels_of(path)[0].as_py() == Tokenizer.from_file(path).id_to_token(0)


def test_best_two_fit_refills():
    # greedy: 6 3, gap 1; the 3 goes for 2 and 2, which fill the gap of 4
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == ((6, 2, 2), 1)
    for seed in range(20):
        rng = random.Random(seed)
        want = Counter(rng.randint(1, 64) for _ in range(rng.randint(1, 400)))
        plan = packing.best_two_fit(dict(want), 64)
        used = Counter()
        for inside, times in plan:
            assert sum(inside) <= 64
            for n in inside:
                used[n] += times
        assert used == want
        gaps: list[int] = []  # first-fit decreasing
        for n in sorted(want.elements(), reverse=True):
            k = next((k for k, g in enumerate(gaps) if g >= n), None)
            if k is None:
                gaps.append(64 - n)
            else:
                gaps[k] -= n
        assert sum(t for _, t in plan) <= len(gaps) + 1


def test_packing(spark, library):
    texts = [*ODD, None, "word " * 5000, "same", "same"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(3, ODD[3], 3)], "doc_id long, text string, length long")
    rows = packing.pack_documents(docs, PATH, 2048).collect()
    want = Counter()
    for i, t in [*enumerate(texts), (3, ODD[3])]:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(-(-len(ids) // 2048)):
            part = ids[2048 * k : 2048 * (k + 1)]
            want[i, k, 2048 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for s in {r["sequence_id"] for r in rows}:
        inside = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s)
        assert all(o == sum(n for _, n in inside[:k]) for k, (o, _) in enumerate(inside)) and sum(n for _, n in inside) <= 2048
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.assign_sequences(spark.createDataFrame([(1, 9)], "doc_id long, length long"), 8)


def test_packing_keeps_columns_of_any_name(spark):
    pieces = spark.range(500).select((F.col("id") % 60 + 1).alias("length"), "id").withColumns({c: F.lit(i) for i, c in enumerate(("_salt", "_n", "_k", "_rank", "_base"))})
    got = packing.assign_sequences(pieces, 64)
    assert got.columns == [*pieces.columns, "sequence_id", "offset"] and got.count() == 500
    for _, rows in got.toPandas().groupby("sequence_id"):
        ends = sorted((r.offset, r.offset + r.length) for r in rows.itertuples())
        assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and ends[-1][1] <= 64

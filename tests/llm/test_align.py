"""Alignment of two tokenizers against a plain reading of the rule, token by token."""

import hashlib
import random
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from treeweave.llm import align
from treeweave.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "\tx\n\n  y ", "it's <|endoftext|> <s></s> <unk> <0x41> x", "▁ a▁b", "a ▁", "日本語 テキスト", "🙂🙂👍🏽 ok!!!...", "½ ² Ⅷ 123 ٣", "\x00b \x1c c", "ﬁ ŉ ẞ",
    "x" * 3000, "=" * 700 + " " * 50 + "-" * 900, "a  b　 c   d", "é é ñ", "the the the the", "the", "the",
]


def plain(rows):
    """The contract, read off: for each document its groups, then the links of each group one by one."""
    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    back = {v: k for k, v in byte_characters().items()}
    groups, holders = [], defaultdict(int)
    for _, text in rows:
        found = []
        if text:
            a = [(i, bytes(back[c] for c in a_side.id_to_token(i))) for i in a_side.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:-1], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b_side.id_to_piece(i)) for i in b_side.encode(text))]
            if b"".join(x for _, x in a) == (" " + text).encode() == b"".join(x for _, x in b):
                ends = [set(), set()]
                for side, tokens in zip(ends, (a, b), strict=True):
                    at = 0
                    for _, x in tokens:
                        at += len(x)
                        side.add(at)
                both = ends[0] & ends[1]
                split = []
                for tokens in (a, b):
                    at, out = 0, [[]]
                    for i, x in tokens:
                        at += len(x)
                        out[-1].append(i)
                        if at in both:
                            out.append([])
                    split.append(out[:-1])
                found = list(zip(*split, strict=True))
        groups.append(found)
        for pair in {(x, y) for g in found for x in g[0] for y in g[1]}:
            holders[pair] += 1
    best = defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, _), found in zip(rows, groups, strict=True):
        links = [(x, y) for g in found for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in found)
        out.append((doc_id, sum(len(g[0]) for g in found), sum(len(g[1]) for g in found), len(found), len(links), sum(holders[p] == best[p[0]] for p in links), sum(holders[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if found else ""))
    return out


def byte_characters():
    """Bytes to the characters of byte-level vocabularies, as their tokenizer writes them."""
    from tokenizers.pre_tokenizers import ByteLevel

    others = iter(sorted(c for c in ByteLevel.alphabet() if ord(c) > 255))
    shown = {c for c in ByteLevel.alphabet() if ord(c) <= 255}
    return {b: chr(b) if chr(b) in shown else next(others) for b in range(256)}


def by_row(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_odd_texts(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("aeinrth  lm\n'éß.0<|>▁=日本") for _ in range(rng.randint(1, 90))) for _ in range(300)]
    rows = [(2**53 + 1 + i if i % 9 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, stripe int, block string")
    found = align.align(docs, A, B)
    assert found.columns == COLUMNS
    assert by_row(found.collect()) == by_row(plain(rows))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert by_row(QUERIES["op13_striped_alignment"](spark, "/root/testdata/sf0.001").collect()) == by_row(plain([tuple(r) for r in docs.collect()]))


def test_small_blocks_slices_and_memory(spark, monkeypatch):
    """Many blocks, salts, stripes and slices give what few give."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    rows = [tuple(r) for r in docs.collect()] + [(None, "to be or " * 4000), (7, "long" * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = by_row(align.align(docs, A, B).collect())
    known = align.Chunks(A, B)
    for name, value in (("SLICE", 300), ("REMEMBERED", 60_000)):
        monkeypatch.setattr(align, name, value)
    block = align.DocumentBlock(known)
    for doc_id, text in rows:
        block.add(doc_id, text)
    cut_up = {r["place"]: r for r in block.rows(0, 7).to_pylist() if r["place"] is not None}
    got = by_row((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in cut_up.values())
    assert got == by_row((r[0], *r[1:5], r[7]) for r in whole)
    for name, value in (("SALTED", 2), ("CELLS", 100), ("BLOCK_BYTES", 1 << 23)):
        monkeypatch.setattr(align, name, value)
    n_a, n_b = align.vocabulary_sizes(A, B)
    stripes = -(-n_a * n_b * 8 // align.BLOCK_BYTES)
    staged = align.staged(align.document_links(docs, A, B, stripes), "links")
    links, own = staged.filter("stripe IS NOT NULL"), staged.filter("stripe IS NULL")
    counts = align.staged(align.pair_counts(links, stripes, -(-n_a // stripes), n_b), "counts")
    salted = align.link_scores(links, counts, 9, stripes, -(-n_a // stripes), n_b)
    assert by_row(align.documents_with_scores(own, salted).collect()) == whole


def test_large_groups_are_counted(monkeypatch):
    texts = ["=" * 700, "x" * 999, "the cat", "naïve Ünïcödé"]
    few, many = align.Chunks(A, B), align.Chunks(A, B)
    few.learn(texts)
    monkeypatch.setattr(align, "PLAIN_GROUP", 0)
    many.learn(texts)
    assert (few.pairs == many.pairs).all() and (few.times == many.times).all() and (few.counts == many.counts).all()


def test_empty_table(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


@pytest.mark.parametrize("values", [[], [0], [255], [256, 1], [65536], [2**40]])
def test_packed_numbers(values):
    import numpy as np

    assert align.unpacked(align.packed(np.array(values, np.int64))).tolist() == values

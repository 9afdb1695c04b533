"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input joins an embedding of the word with the mean embedding of its character n-grams. Two gated recurrent
layers read a window of words from either end, attention pools their states, and a logit comes out. A document's score is
that of its worst window; overlapping windows cover every word of it.

Labels are of documents, insults are a few words. So training starts from the windows that the
sample's own word and n-gram statistics single out: in toxic documents the likeliest, in clean ones the likeliest and one
at random, as counterexamples.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import held

#: Words of a window and between the starts of two.
WINDOW, STRIDE = 32, 24
#: Most labelled documents that training takes of each label.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1200, 2400
HIDDEN, WORD_DIM, CHAR_DIM = 8, 4, 8
WORD_BITS, CHAR_BITS = 17, 18
NGRAMS = (3, 4, 5)
#: Scores from here on count as toxic; training sets the scale so that this is where the two labels part best.
THRESHOLD = 0.3
#: Steps of training at least, and how often counterexamples are sought.
STEPS, ROUNDS = 60, 3
#: The share of clean documents in which no word stands out as much as one must in a toxic one.
USUAL = 0.9
#: Words that one Python worker remembers the input of.
REMEMBERED = 100_000
WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def word_buckets(words: list[str]) -> np.ndarray:
    """A bucket of the word table for each word."""
    return ngram_buckets(words, (0,), WORD_BITS)[1]


def ngram_buckets(words: list[str], sizes: tuple[int, ...] = NGRAMS, bits: int = CHAR_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of each n-gram of ``\\nword\\n``, in the words' order for each size; size 0 is the whole word."""
    codes = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "replace"), np.uint32)
    edge = codes == 10
    number = np.cumsum(edge) - 1
    mixed = (codes * np.uint32(2654435761)) ^ (codes >> np.uint32(7))
    owners, buckets = [], []
    for n in sizes:
        if n == 0:
            at = np.flatnonzero(edge)[:-1]
            place = np.arange(len(codes)) - np.flatnonzero(edge)[number]
            power = np.cumprod(np.concatenate([[1], np.full(int(place.max()) if len(place) else 0, 1000003)]).astype(np.uint32), dtype=np.uint32)
            h = np.add.reduceat((mixed * power[place])[:-1], at, dtype=np.uint32) if len(words) else np.empty(0, np.uint32)
            owner = np.arange(len(words))
        else:
            if len(codes) < n:
                continue
            h = np.zeros(len(codes) - n + 1, np.uint32)
            inside = np.ones(len(h), bool)
            for j in range(n):
                h = h * np.uint32(1000003) + mixed[j : j + len(h)]
                if 0 < j < n - 1:
                    inside &= ~edge[j : j + len(h)]
            h, owner = h[inside], number[: len(inside)][inside]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
        owners.append(owner.astype(np.int32))
        buckets.append((h >> np.uint32(32 - bits)).astype(np.int32))
    return np.concatenate(owners), np.concatenate(buckets)


def window_starts(n: int) -> np.ndarray:
    """Where the windows of ``n`` words start: every STRIDE words, the last one flush with the end."""
    return np.arange(0, max(n - WINDOW, 0) + STRIDE, STRIDE).clip(0, max(n - WINDOW, 0))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def summed(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of rows of ``values`` by place, for the places that occur."""
    places, inverse = np.unique(at, return_inverse=True)
    return places, np.stack([np.bincount(inverse, v, len(places)) for v in values.T], 1).astype(values.dtype)


class Network:
    """Its parameters are a dict of float32 arrays; ``scale`` and ``shift`` turn a document's logit into its score."""

    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        small = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {"word": small(1 << WORD_BITS, WORD_DIM) * np.float32(0.03), "char": small(1 << CHAR_BITS, CHAR_DIM) * np.float32(0.03)}
        for side in "fb":
            self.p |= {f"W{side}": small(d, 3 * h), f"U{side}": small(h, 3 * h), f"b{side}": np.zeros(3 * h, np.float32)}
        self.p |= {"attend": small(2 * h), "out": small(2 * h), "bias": np.zeros(1, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """A row for each word, and what the gradient needs to come back to the embeddings."""
        w = word_buckets(words)
        owner, bucket = ngram_buckets(words)
        count = np.bincount(owner, minlength=len(words)).clip(1)
        e = self.p["char"][bucket]
        chars = np.stack([np.bincount(owner, e[:, k], len(words)) for k in range(CHAR_DIM)], 1) / count[:, None]
        return np.concatenate([self.p["word"][w], chars.astype(np.float32)], 1), (w, owner, bucket, count)

    def read(self, side: str, projected: np.ndarray, index: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> list[np.ndarray]:
        """The layer's states at each step of the windows ``index`` (steps by windows) into ``projected`` rows."""
        h = HIDDEN
        state = np.zeros((index.shape[1], h), np.float32)
        states: list[np.ndarray] = [state] * len(index)
        u = self.p[f"U{side}"]
        for t in range(len(index)) if side == "f" else range(len(index) - 1, -1, -1):
            x, r = projected[index[t]], state @ u
            gates = x[:, : 2 * h] + r[:, : 2 * h]
            gates = 1 / (1 + np.exp(-gates))
            z, reset = gates[:, :h], gates[:, h:]
            c = np.tanh(x[:, 2 * h :] + reset * r[:, 2 * h :])
            new = c + z * (state - c)
            if mask is not None:
                new = np.where(mask[t][:, None], new, state)
            if keep is not None:
                keep.append((t, state, r[:, 2 * h :], z, reset, c))
            states[t] = state = new
        return states

    def pool(self, states: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, attention and the pooled states; ``states``: steps by windows by both layers."""
        a = states @ self.p["attend"]
        if mask is not None:
            a = np.where(mask, a, -1e9)
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        return pooled @ self.p["out"] + self.p["bias"][0], a, pooled

    def logits(self, projected: tuple[np.ndarray, np.ndarray], index: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        states = np.concatenate([np.stack(self.read(s, p, index, mask)) for s, p in zip("fb", projected, strict=True)], 2)
        return self.pool(states, mask)[0]

    def step(self, words: list[str], index: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the log loss over a batch of windows."""
        out = {}
        for k, (rows, values) in self.gradients(words, index, mask, y).items():
            out[k] = np.zeros_like(self.p[k])
            out[k][rows] = values
        return out

    def gradients(self, words: list[str], index: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, tuple[np.ndarray | slice, np.ndarray]]:
        """The rows of each parameter that have a gradient, and these."""
        h, n = HIDDEN, len(y)
        x, (w, owner, bucket, count) = self.inputs(words)
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([np.stack(self.read(s, x @ self.p[f"W{s}"] + self.p[f"b{s}"], index, mask, kept[s])) for s in "fb"], 2)
        logit, a, pooled = self.pool(states, mask)
        d = ((sigmoid(logit) - y) / n).astype(np.float32)
        g = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
        d_pooled = d[:, None] * self.p["out"]
        d_a = np.einsum("tnh,nh->tn", states, d_pooled)
        d_score = a * (d_a - (a * d_a).sum(0))
        g["attend"] = np.einsum("tn,tnh->h", d_score, states)
        d_states = a[:, :, None] * d_pooled + d_score[:, :, None] * self.p["attend"]
        d_x = np.zeros_like(x)
        for k, s in enumerate("fb"):
            d_p, g_u = np.zeros((len(x), 3 * h), np.float32), np.zeros_like(self.p[f"U{s}"])
            carry = np.zeros((n, h), np.float32)
            for t, before, rc, z, reset, c in reversed(kept[s]):
                d_h = carry + d_states[t, :, k * h : (k + 1) * h]
                on = mask[t][:, None]
                d_new = np.where(on, d_h, 0)
                d_c = d_new * (1 - z) * (1 - c * c)
                d_gates = np.concatenate([d_new * (before - c) * z * (1 - z), d_c * rc * reset * (1 - reset)], 1)
                d_r = np.concatenate([d_gates, d_c * reset], 1)
                g_u += before.T @ d_r
                carry = np.where(on, d_new * z + d_r @ self.p[f"U{s}"].T, d_h)
                np.add.at(d_p, index[t], np.concatenate([d_gates, d_c], 1))
            g |= {f"U{s}": g_u, f"W{s}": x.T @ d_p, f"b{s}": d_p.sum(0)}
            d_x += d_p @ self.p[f"W{s}"].T
        out: dict[str, tuple[np.ndarray | slice, np.ndarray]] = {k: (slice(None), v) for k, v in g.items()}
        out["word"] = summed(w, d_x[:, :WORD_DIM])
        out["char"] = summed(bucket, (d_x[:, WORD_DIM:] / count[:, None])[owner])
        return out


def batch_windows(docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of documents given as word numbers: (steps by windows) numbers, the mask, and each window's document."""
    starts = [window_starts(len(d)) for d in docs]
    owner = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
    sizes = np.array([len(d) for d in docs], np.int64)
    flat = np.fromiter(chain(chain.from_iterable(docs), [0]), np.int64, int(sizes.sum()) + 1)
    first = np.concatenate([[0], np.cumsum(sizes)])[owner] + np.concatenate(starts)
    at = np.arange(WINDOW)[:, None]
    mask = at < (sizes[owner] - np.concatenate(starts))
    return flat[np.where(mask, first + at, len(flat) - 1)], mask, owner


def train(texts: list[str], labels: list[int], epochs: int = 4, seed: int = 9) -> Network | float:
    """Fit to labelled documents; without both labels, the one score that fits.

    Where scores count as toxic is settled on documents that the network hasn't seen: a fifth of them, and where that is
    fewer than 200, up to five fifths in turn, each read by a network of its own.
    """
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return float(y.max()) if len(y) else 0.0
    vocabulary = Numbers()
    numbered = [np.array([*map(vocabulary.__getitem__, words_of(t))], np.int32) for t in texts]  # words as strings are kept once
    words = vocabulary.new
    if not words:
        return 0.0
    owner, bucket = ngram_buckets(words)
    order = np.argsort(owner, kind="stable")
    owner, bucket = owner[order].astype(np.int32), bucket[order].astype(np.int32)
    del order
    tables = words, word_buckets(words), bucket, np.searchsorted(owner, np.arange(len(words) + 1))
    rng = np.random.default_rng(seed)
    part = np.empty(len(y), np.int64)
    for label in (0, 1):  # each fifth has its share of both labels
        own = np.flatnonzero(y == label)
        part[rng.permutation(own)] = (np.arange(len(own)) + rng.integers(5)) % 5
    rounds = int(np.clip(np.ceil(1000 / len(y)), 1, 5))
    scores, truth = [], []
    for k in range(rounds):
        unseen = np.flatnonzero(part == k)
        net = fitted(numbered, y, np.flatnonzero(part != k), tables, epochs, seed)
        scorer = Scorer(net)
        scores += [scorer.logits([[words[n] for n in numbered[i]] for i in unseen[at : at + 100]]) for at in range(0, len(unseen), 100)]
        truth.append(y[unseen])
    if rounds > 1:
        net = fitted(numbered, y, np.arange(len(y)), tables, epochs, seed)
    net.shift, net.scale = parting(np.concatenate(scores), np.concatenate(truth))
    return net


def parting(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Where logits part the labels best, and a scale that spreads them around it.

    The best place is the one with the highest F score, of equals the highest; then halfway down to the next document.
    """
    rising = np.argsort(z, kind="stable")
    cut, true = z[rising], y[rising]
    hits = true[::-1].cumsum()[::-1]
    f = 2 * hits / (np.arange(len(cut), 0, -1) + true.sum())
    best = len(f) - 1 - int(np.argmax(f[::-1]))
    shift = float(cut[best] if best == 0 or not np.isfinite(cut[best - 1]) else (cut[best] + cut[best - 1]) / 2)
    spread = np.abs(z[np.isfinite(z)] - shift)
    return shift, float(4 / max(1.0, spread.mean() if len(spread) else 1.0))


def log_odds(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How much likelier than in clean documents each word is in toxic ones, by the documents of both kinds that hold it; shrunk where seldom seen."""
    clean, toxic = seen.clip(0)
    o = np.log((toxic + 0.5) / (n[1] + 1)) - np.log((clean + 0.5) / (n[0] + 1))
    return (o * (clean + toxic) / (clean + toxic + 10)).astype(np.float32)


def fitted(numbered: list[np.ndarray], y: np.ndarray, rows: np.ndarray, tables: tuple, epochs: int, seed: int) -> Network:
    """A network fitted to the documents ``rows``; ``tables``: the words, their buckets, and their n-grams' buckets with where each word's begin."""
    words, by_word, bucket, first = tables
    rng = np.random.default_rng(seed)
    net = Network(seed)
    seen = {k: np.zeros((2, 1 << b)) for k, b in (("word", WORD_BITS), ("char", CHAR_BITS))}
    for d, label in zip([numbered[i] for i in rows], y[rows], strict=True):
        own = np.unique(d)
        seen["word"][label, np.unique(by_word[own])] += 1
        if len(own):
            seen["char"][label, np.unique(np.concatenate([bucket[first[i] : first[i + 1]] for i in own]))] += 1
    n = np.array([(1 - y[rows]).sum(), y[rows].sum()])
    odds = {k: log_odds(x, n) for k, x in seen.items()}
    for k, o in odds.items():
        net.p[k][:, 0] += o / 2
    by_ngram = np.maximum.reduceat(np.append(odds["char"][bucket], 0), first[:-1]) * (np.diff(first) > 0)
    likely = odds["word"][by_word] + by_ngram
    # a toxic document in which no word stands out, its own label left out of the count, is taken for mislabelled
    apart = [log_odds(seen["word"] - np.array([[label == 0], [label == 1]]), n - np.array([label == 0, label == 1])) for label in (0, 1)]
    alone = np.array([apart[label][by_word[d]].max(initial=-9) for d, label in zip([numbered[i] for i in rows], y[rows], strict=True)])
    usual = np.quantile(alone[y[rows] == 0], USUAL) if n[0] else -9
    rows = rows[(y[rows] == 0) | (alone > usual)] if (alone[y[rows] == 1] > usual).any() else rows
    docs, label = [numbered[i] for i in rows], y[rows]
    picked: list[np.ndarray] = []
    targets: list[int] = []
    for d, toxic in zip(docs, label, strict=True):
        starts = window_starts(len(d))
        worst = np.array([likely[d[s : s + WINDOW]].max() if len(d) else 0 for s in starts])
        chosen = {*np.argsort(-worst, kind="stable")[:2]} | ({int(rng.integers(len(starts)))} if not toxic else set())
        picked += [d[s : s + WINDOW] for s in starts[sorted(chosen)]]
        targets += [int(toxic)] * len(chosen)
    stands = odds["word"][by_word] > usual
    common = np.concatenate([d for d, toxic in zip(docs, label, strict=True) if not toxic] + [np.zeros(1, np.int64)])
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    count = 0
    for round_ in range(ROUNDS):
        if round_:  # what the network itself takes for the worst window of a clean document is a counterexample too
            scorer = Scorer(net)
            for at in range(0, len(docs), 100):
                some = [d for d, toxic in zip(docs[at : at + 100], label[at : at + 100], strict=True) if not toxic]
                worst = scorer.worst([[words[n] for n in d] for d in some])
                picked += [d[s : s + WINDOW] for d, s in zip(some, worst, strict=True)]
                targets += [0] * len(some)
        target = np.array(targets, np.float32)
        for _ in range(max(epochs, -(-STEPS * 256 // max(1, len(picked)))) // ROUNDS + 1):  # small samples are gone through more often
            shuffled = rng.permutation(len(picked))
            for at in range(0, len(picked), 256):
                part = shuffled[at : at + 256]
                index, mask, _ = batch_windows([picked[i].tolist() for i in part])
                # in toxic windows half of the words that don't stand out give way to clean documents' words: not to be learned by heart
                swapped = (target[part] == 1) & ~stands[index] & (rng.random(index.shape) < 0.5)
                index = np.where(swapped, rng.choice(common, index.shape), index)
                used, inverse = np.unique(index, return_inverse=True)
                count += 1
                for k, (at_, v) in net.gradients([words[i] for i in used], inverse.reshape(index.shape), mask, target[part]).items():
                    mean, square = moments[k]
                    mean[at_] += 0.1 * (v - mean[at_])
                    square[at_] += 0.01 * (v**2 - square[at_])
                    net.p[k][at_] -= 0.01 * (mean[at_] / (1 - 0.9**count)) / (np.sqrt(square[at_] / (1 - 0.99**count)) + 1e-6)
    return net


class Numbers(dict):
    """Numbers words as they come; ``new`` are those of them without an input row yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Scorer:
    """Scores documents; remembers the projected input of words, so that a window step costs only its recurrence."""

    def __init__(self, net: Network):
        self.net = net
        self.numbers = Numbers()
        self.rows = [np.empty((1 << 16, 3 * HIDDEN), np.float32) for _ in "fb"]

    def number(self, docs: list[list[str]]) -> list[list[int]]:
        if len(self.numbers) > REMEMBERED:
            self.numbers = Numbers()
        known = len(self.numbers)
        out = [[*map(self.numbers.__getitem__, d)] for d in docs]
        new, self.numbers.new = self.numbers.new, []
        if new:
            x, _ = self.net.inputs(new)
            for k, s in enumerate("fb"):
                while len(self.rows[k]) < known + len(new):
                    self.rows[k] = np.concatenate([self.rows[k], np.empty_like(self.rows[k])])
                self.rows[k][known : known + len(new)] = x @ self.net.p[f"W{s}"] + self.net.p[f"b{s}"]
        return out

    def windows(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Each window's document and logit, in order; documents without words have none."""
        some = np.array([i for i, d in enumerate(docs) if d], np.int64)
        if not len(some):
            return some, np.empty(0, np.float32)
        index, mask, owner = batch_windows(self.number([docs[i] for i in some]))
        z = []
        for at in range(0, len(owner), 2048):
            part = slice(at, at + 2048)
            whole = mask[:, part].all()
            z.append(self.net.logits(tuple(self.rows), index[:, part], None if whole else mask[:, part]))
        return some[owner], np.concatenate(z)

    def logits(self, docs: list[list[str]]) -> np.ndarray:
        """The worst window's logit for each document."""
        out = np.full(len(docs), -np.inf)
        np.maximum.at(out, *self.windows(docs))
        return out

    def worst(self, docs: list[list[str]]) -> np.ndarray:
        """Where each document's worst window starts."""
        owner, z = self.windows(docs)
        order = np.lexsort((-z, owner))
        owner = owner[order]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        out = np.zeros(len(docs), np.int64)
        number = order - np.searchsorted(owner, owner)  # windows of a document follow each other
        for i, k in zip(owner[first], number[first], strict=True):
            out[i] = window_starts(len(docs[i]))[k]
        return out

    def scores(self, docs: list[list[str]]) -> np.ndarray:
        z = (self.logits(docs) - self.net.shift) * self.net.scale + np.log(THRESHOLD / (1 - THRESHOLD))
        return np.where(np.isneginf(z), 0.0, sigmoid(np.clip(z, -60, 60)))


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column) -> tuple[list[str], list[int]]:
    """Texts and labels of up to SAMPLE_TOXIC and SAMPLE_CLEAN documents, the first by a hash of their ids.

    Ids that carry both labels, and null ids, labels and texts, take no part.
    """
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & usable).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
    own = own.filter(F.col("toxic") == F.col("other")).select("doc_id", "toxic", F.xxhash64(F.lit(9), "doc_id").alias("h"))
    pick = [own.filter(F.col("toxic") == v).orderBy("h").limit(n) for v, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    chosen = F.broadcast(pick[0].unionByName(pick[1]))  # SAMPLE_TOXIC + SAMPLE_CLEAN rows at most
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(chosen, "doc_id").groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text"))
    found = sorted((r["h"], r["toxic"], r["text"]) for r in rows.collect())
    return [r[2] for r in found], [r[1] for r in found]


def score(docs: DataFrame, model: Network | float, text: str = "text", names: Sequence[str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on), over whole texts.

    A text that is null or has no word scores 0. Other columns stay; ones of the two ``names`` are replaced.
    """
    kept = [c for c in docs.columns if c not in names]
    rest = docs.select(*(F.col(f"`{c}`") for c in kept))
    model_ = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model_.value
        scorer = held(("toxicity", name), lambda: Scorer(net)) if isinstance(net, Network) else None
        for batch in batches:
            found = np.full(batch.num_rows, float(net) if scorer is None else 0.0)
            pending: list[list[str]] = []
            size = 0
            if scorer is not None:
                for i, t in enumerate(batch.column(text).to_pylist()):
                    pending.append(words_of(t))
                    size += len(pending[-1])
                    if size >= 50_000 or i + 1 == batch.num_rows:
                        found[i + 1 - len(pending) : i + 1] = scorer.scores(pending)
                        pending, size = [], 0
            predicted = (found >= THRESHOLD).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(found), pa.array(predicted)], names=[*kept, *names])

    return rest.mapInArrow(run, rest.withColumns({names[0]: F.lit(0.0), names[1]: F.lit(0)}).schema)

"""The toxicity network against a plain forward pass: one window, one word, one number at a time."""

import math
import random

import numpy as np

from treeweave.llm import toxicity
from treeweave.llm.toxicity import CHAR_DIM, HIDDEN, STRIDE, THRESHOLD, WINDOW, Network, Scorer


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def word_input(net, word):
    """An embedding of the word, and the mean of its n-grams' embeddings."""
    row = [float(v) for v in net.p["word"][toxicity.word_buckets([word])[0]]]
    _, buckets = toxicity.ngram_buckets([word])
    chars = [sum(float(net.p["char"][b][k]) for b in buckets) / max(1, len(buckets)) for k in range(CHAR_DIM)]
    return row + chars


def layer(net, side, inputs):
    """A gated recurrent layer, as the equations have it."""
    w, u, b = net.p[f"W{side}"].tolist(), net.p[f"U{side}"].tolist(), net.p[f"b{side}"].tolist()
    state, out = [0.0] * HIDDEN, {}
    for t in range(len(inputs)) if side == "f" else reversed(range(len(inputs))):
        x = [b[j] + sum(v * w[i][j] for i, v in enumerate(inputs[t])) for j in range(3 * HIDDEN)]
        r = [sum(v * u[i][j] for i, v in enumerate(state)) for j in range(3 * HIDDEN)]
        new = []
        for j in range(HIDDEN):
            keep, reset = sigmoid(x[j] + r[j]), sigmoid(x[HIDDEN + j] + r[HIDDEN + j])
            new.append((1 - keep) * math.tanh(x[2 * HIDDEN + j] + reset * r[2 * HIDDEN + j]) + keep * state[j])
        out[t] = state = new
    return [out[t] for t in range(len(inputs))]


def window_logit(net, words):
    inputs = [word_input(net, w) for w in words]
    states = [f + b for f, b in zip(layer(net, "f", inputs), layer(net, "b", inputs), strict=True)]
    attend, out = net.p["attend"].tolist(), net.p["out"].tolist()
    weights = [math.exp(sum(a * s for a, s in zip(attend, state, strict=True))) for state in states]
    pooled = [sum(w * state[j] for w, state in zip(weights, states, strict=True)) / sum(weights) for j in range(2 * HIDDEN)]
    return sum(p * o for p, o in zip(pooled, out, strict=True)) + float(net.p["bias"][0])


def score(net, text):
    words = toxicity.words_of(text)
    if not words:
        return 0.0
    # every STRIDE words a window, and one that ends with the text
    starts = [0] if len(words) <= WINDOW else sorted({*range(0, len(words) - WINDOW, STRIDE), len(words) - WINDOW})
    worst = max(window_logit(net, words[s : s + WINDOW]) for s in starts)
    return sigmoid((worst - net.shift) * net.scale + math.log(THRESHOLD / (1 - THRESHOLD)))


def test_scores_are_those_of_a_plain_pass():
    rng = random.Random(12)
    net = Network(3)
    for k in ("word", "char"):
        net.p[k] = net.p[k] * np.float32(40)
    net.scale, net.shift = 1.7, 0.2
    texts = [None, "", "!!", "one", *(" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n)) for n in (2, 31, 32, 33, 56, 57, 140))]
    found = Scorer(net).scores([toxicity.words_of(t) for t in texts])
    assert np.allclose(found, [score(net, t) for t in texts], atol=2e-4) and np.ptp(found[4:]) > 0.01


def test_a_trained_network_scores_as_a_plain_pass(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    net = toxicity.train(*toxicity.labelled_sample(docs, labels, labels["doc_id"].isNotNull()))
    rows = docs.select("doc_id", "text").orderBy("n_chars").limit(40)
    found = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(rows, net).collect()}
    for doc_id, text in rows.collect():
        plain = score(net, text)
        assert abs(found[doc_id][0] - plain) < 1e-3 and (found[doc_id][1] == (plain >= THRESHOLD) or abs(plain - THRESHOLD) < 1e-3)


def test_a_words_input_is_its_own():
    """Whatever words are numbered with it, and wherever it stands among them."""
    net, words = Network(3), ["one", "abc", "é", "bcdeab", "one"]
    together, _ = net.inputs(words)
    for i, w in enumerate(words):
        assert (together[i] == net.inputs([w])[0][0]).all()

"""Quality: kernel ridge regression on document statistics, by random Fourier features, with isotonic calibration.

A document is some thirty numbers about the whole of its text. Cosines of fixed random projections of them approximate a Gaussian kernel;
on these the ridge score is linear, so its normal equations are sums over documents: each partition adds up its own, by fold, and the
partitions' sums are added in a shuffle. What remains is a system of as many unknowns as there are cosines. Leaving a fold's sums
out fits a model that hasn't seen the fold; with such scores the penalty is chosen and the calibration is fitted, on counts by score.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from itertools import pairwise
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, staged

#: Cosines, and the width of the kernel for statistics of unit variance, as a multiple of the root of their number.
FEATURES, WIDTH = 256, 1.0
FOLDS = 5
PENALTIES = (1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0)
#: Scores from here on count as good.
THRESHOLD = 0.5
#: Calibration counts scores by steps of 1 / BINS.
BINS = 512
#: Standardised statistics are cut here, so that one odd document is no place of its own.
FAR = 4.0
SEED = 11
#: Rows that are scored at a time.
ROWS = 4096
#: Characters of a text that are classed at a time.
SLICE = 1_000_000

STATISTICS = (
    "chars", "words", "word_length", "word_length_spread", "lower", "upper", "other_letters", "digits", "sentence_marks", "other_marks", "symbols", "spaces", "line_ends", "rest",
    "distinct_words", "commonest_word", "repeated_next", "repeated_pairs", "upper_words", "letter_words", "plain_words", "bare_marks", "short_words", "long_words", "distinct_lines",
    "commonest_line", "line_words", "sentence_words", "commonest_mark", "loud_marks", "characters_known",
)
CLASSES = 10
CLOSING = ".,;:!?"
ENDS = [*map(ord, ".!?")]
UNUSUAL = [*map(ord, "!|*#$%&@~=+^_<>{}[]\\/\"'()-")]
ALNUM = re.compile(r"\w")


@cache
def classes() -> np.ndarray:
    """The class of each code point: lower, upper, other letter, digit, sentence mark, other mark, symbol, space, end of line, rest."""
    kinds = {"Ll": 0, "Lu": 1, "Lt": 1, "Lm": 2, "Lo": 2, "Mn": 2, "Mc": 2, "Nd": 3, "Zs": 7, "Sc": 6, "Sk": 6, "Sm": 6, "So": 6}
    out = np.fromiter((kinds.get(k, 5 if k[0] == "P" else 9) for k in map(unicodedata.category, map(chr, range(sys.maxunicode + 1)))), np.uint8, sys.maxunicode + 1)
    out[[*map(ord, CLOSING)]] = 4
    out[ord("\t")], out[[10, 13]] = 7, 8
    return out


def statistics_of(text: str | None) -> list[float]:
    """STATISTICS of a whole text; null is as empty."""
    text = text or ""
    found, ascii_ = np.zeros(CLASSES, np.int64), np.zeros(128, np.int64)
    for at in range(0, len(text), SLICE):
        points = np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), "<u4")
        found += np.bincount(classes()[points], minlength=CLASSES)
        ascii_ += np.bincount(points[points < 128], minlength=128)
    words = text.split()
    n, m = max(1, len(text)), max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    often = Counter(words)
    bare = [w.rstrip(CLOSING) for w in often]
    d = max(1, len(bare))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    by_line = Counter(lines)
    marks = ascii_[UNUSUAL]
    return [
        np.log1p(len(text)), np.log1p(len(words)), float(lengths.mean()) if words else 0.0, float(lengths.std()) if words else 0.0, *(found / n),
        np.log1p(len(often)) / np.log1p(m), max(often.values(), default=0) / m, sum(map(eq, words, words[1:])) / m, (len(words) - len(set(pairwise(words)))) / m if words else 0.0,
        sum(map(str.isupper, bare)) / d, sum(map(str.isalpha, bare)) / d, (sum(map(str.islower, bare)) + sum(map(str.istitle, bare))) / d, (len(bare) - sum(map(bool, map(ALNUM.search, bare)))) / d,
        float((lengths <= 3).mean()) if words else 0.0, float((lengths > 20).mean()) if words else 0.0,
        len(by_line) / max(1, len(lines)), max(by_line.values(), default=0) / max(1, len(lines)), np.log1p(len(words) / max(1, len(lines))), np.log1p(len(words) / (1 + ascii_[ENDS].sum())),
        marks.max() / m, ascii_[ord("!")] / m, np.log1p(len(set(text))),
    ]


def measure(docs: DataFrame, text: str = "text", name: str = "stats") -> DataFrame:
    """``docs`` with ``name``, the statistics of ``text``, instead of the text. Rows are independent; other columns stay."""
    kept = [c for c in docs.columns if c not in (text, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics_of(t.as_py()) for t in batch.column(text)]
            flat = np.array(rows, np.float64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists], names=[*kept, name])

    rest = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias(text))
    return rest.mapInArrow(run, rest.drop(text).withColumn(name, F.lit(None).cast("array<double>")).schema)


@dataclass(frozen=True)
class Kernel:
    """Standardised statistics to cosines (and a constant)."""

    mean: np.ndarray
    spread: np.ndarray

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -FAR, FAR)
        rng = np.random.default_rng(SEED)
        directions = rng.normal(size=(x.shape[1], FEATURES)) / (WIDTH * np.sqrt(x.shape[1]))
        z = np.cos(x @ directions + rng.uniform(0, 2 * np.pi, FEATURES)) * np.sqrt(2 / FEATURES)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)


@dataclass(frozen=True)
class Model:
    """A kernel, the ridge score's weights, and the calibration: raw scores and the shares of good documents there, both rising."""

    kernel: Kernel | None
    weights: np.ndarray
    raw: np.ndarray
    good: np.ndarray

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(stats), self.good[0])
        return np.interp(self.kernel.cosines(stats) @ self.weights, self.raw, self.good)


def isotonic(values: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, float]]:
    """Pool adjacent violators: (first, last, value) of the blocks of the rising sequence nearest to ``values``."""
    blocks: list[list[float]] = []
    for i, (v, w) in enumerate(zip(values.tolist(), weights.tolist(), strict=True)):
        blocks.append([i, i, v * w, w])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, last, total, weight = blocks.pop()
            blocks[-1][1] = last
            blocks[-1][2] += total
            blocks[-1][3] += weight
    return [(int(a), int(b), t / w) for a, b, t, w in blocks]


def normal_equations(rows: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By fold: products of cosines, products with the label, and squared labels, summed over ``rows`` (fold, y, stats).

    A partition sends one row for each fold and cosine; the sums are FOLDS * FEATURES rows, whatever the input.
    """
    held = rows.sparkSession.sparkContext.broadcast(kernel)
    size = FEATURES + 1

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, size, size + 2))
        for batch in batches:
            folds, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            z = held.value.cosines(np.array(batch.column(2).to_pylist()))
            for f in np.unique(folds):
                part = z[folds == f]
                total[f] += np.concatenate([part.T @ part, (part.T @ y[folds == f])[:, None], np.full((size, 1), (y[folds == f] ** 2).sum())], axis=1)
        present = [f for f in range(FOLDS) if total[f].any()]
        if present:
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f in present for _ in range(size)], pa.int32()), pa.array([*range(size)] * len(present), pa.int32()), pa.array([r.tobytes() for f in present for r in total[f]], pa.binary())],
                names=["fold", "place", "sums"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}  # FOLDS * (FEATURES + 1) at most
        for batch in batches:
            for f, place, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(sums)
                total[f, place] = total[f, place] + x if (f, place) in total else x
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["fold", "place", "sums"]
            )

    schema = "fold int, place int, sums binary"
    merged = rows.select("fold", "y", "stats").mapInArrow(own, schema).repartition(8, "fold", "place").mapInArrow(add, schema)
    out = np.zeros((FOLDS, size, size + 2))
    for f, place, sums in merged.collect():
        out[f, place] = np.frombuffer(sums)
    return out[:, :, :size], out[:, :, size], out[:, 0, size + 1]


def ridge(a: np.ndarray, b: np.ndarray, penalty: float) -> np.ndarray:
    """The constant, which comes last, is not penalised."""
    return np.linalg.solve(a + np.diag([penalty] * FEATURES + [1e-9]), b)


def train(measured: DataFrame, labels: DataFrame, usable: Column, label: str = "quality") -> Model:
    """Fit on the statistics of all labelled documents (doc_id, stats) whose id is ``usable``; ``labels`` has doc_id and ``label``, 0 or 1.

    Ids that carry both labels, null ids and null labels take no part; every row of an id has its label. No labelled documents: 0.5 for all; labels all
    alike: that for all.
    """
    own = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & usable).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_other"))
    own = own.filter(F.col("y") == F.col("_other")).select("doc_id", F.col("y").cast("double").alias("y"))
    rows = measured.select("doc_id", "stats").join(own, "doc_id").select(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), "y", "stats")
    rows = staged(rows, "labelled")
    columns = [F.col("stats")[i] for i in range(len(STATISTICS))]
    summary = rows.agg(F.count("y"), F.avg("y"), *map(F.avg, columns), *map(F.stddev_pop, columns)).first()
    number, average = summary[0], summary[1]
    if not number or average in (0, 1):
        return Model(None, np.empty(0), np.zeros(1), np.array([0.5 if average is None else average]))
    mean, spread = (np.array(summary[2 + k * len(columns) : 2 + (k + 1) * len(columns)], np.float64) for k in (0, 1))
    kernel = Kernel(mean, np.where(spread > 1e-9, spread, 1.0))
    a, b, squares = normal_equations(rows, kernel)
    errors, fits = [], []
    for penalty in PENALTIES:
        fit = [ridge(a.sum(0) - a[f], b.sum(0) - b[f], penalty) for f in range(FOLDS)]
        errors.append(sum(w @ a[f] @ w - 2 * w @ b[f] + squares[f] for f, w in enumerate(fit)))
        fits.append(fit)
    best = int(np.argmin(errors))
    counted = unseen_scores(rows, kernel, np.array(fits[best]))
    raw, good = calibration(counted)
    return Model(kernel, ridge(a.sum(0), b.sum(0), PENALTIES[best]), raw, good)


def unseen_scores(rows: DataFrame, kernel: Kernel, fits: np.ndarray) -> list[tuple[int, int, float]]:
    """(bin, documents, good ones) of the scores that each fold gets from the model that left it out."""
    held = rows.sparkSession.sparkContext.broadcast((kernel, fits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel_, fits_ = held.value
        for batch in batches:
            z = kernel_.cosines(np.array(batch.column(2).to_pylist()))
            raw = (z * fits_[batch.column(0).to_numpy()]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(np.clip(raw, -1, 2) * BINS).astype(np.int64)), batch.column(1)], names=["bin", "y"])

    counted = rows.select("fold", "y", "stats").mapInArrow(run, "bin long, y double").groupBy("bin").agg(F.count("y"), F.sum("y")).orderBy("bin")
    return [tuple(r) for r in counted.collect()]  # 3 * BINS + 1 at most


def calibration(counted: Sequence[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores and calibrated ones between which to draw lines: the isotonic blocks' middles."""
    bins, number, good = (np.array(c, np.float64) for c in zip(*counted, strict=True))
    raw, level = [], []
    for first, last, value in isotonic(good / number, number):
        inside = slice(first, last + 1)
        raw.append((((bins[inside] + 0.5) / BINS) @ number[inside]) / number[inside].sum())
        level.append(value)
    return np.array(raw), np.array(level)


def score(measured: DataFrame, model: Model, names: Sequence[str] = ("score", "predicted"), stats: str = "stats") -> DataFrame:
    """``measured`` with ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on) instead of its statistics; other columns stay, ones of the two ``names`` are replaced."""
    kept = [c for c in measured.columns if c not in (stats, *names)]
    held = measured.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                flat = part.column(stats).flatten().to_numpy().reshape(part.num_rows, -1)
                found = held.value.scores(flat)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], names=[*kept, *names])

    rest = measured.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{stats}`"))
    return rest.mapInArrow(run, rest.drop(stats).withColumns({names[0]: F.lit(0.0), names[1]: F.lit(0)}).schema)


def judge(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality") -> DataFrame:
    """``docs`` (doc_id, text and others) without their text, with ``score`` and ``predicted``; learned from the ``usable`` labelled ones.

    Texts are read once; what is staged is some thirty numbers a document.
    """
    (stats,) = fresh(docs.columns, "stats")
    measured = staged(measure(docs, name=stats), "measured")
    model = train(measured.select(F.col("doc_id"), F.col(stats).alias("stats")), labels, usable, label)
    return score(measured, model, stats=stats)

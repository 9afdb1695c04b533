"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. Read against it, a text falls into phrases, each the
longest match of what comes next. Phrases times the logarithm of the automaton's text's length, by the text's length, estimate
the cross entropy, so languages learned from less text are not at a loss; the language with the least wins.

Parsing needs no suffix links: where no arc goes on, the phrase ends and the next one starts at the root. So the
automaton becomes a table of arcs, and a batch of texts steps through it at once. Long texts are read from several
places at a time; each stretch is then read again from the state in which the one before ended, until both
readings begin a phrase at one place, from which on they are the same. So phrases are those of one reading.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import held

#: Characters of labelled text that each language's automaton holds, unless its first document alone is longer; up to how many a document is taken for short;
#: documents of a language, at most. They bound which documents are learned, not their texts.
PER_LANGUAGE, SHORT, DOCUMENTS = 40_000, 5_000, 320
#: Symbols that are read in one go from each place.
RUN = 2048
#: Arcs are a dense table up to so many cells, otherwise (alphabets of thousands of letters) a sorted list.
DENSE = 1 << 24
#: Symbols besides the letters learned: anything between words, and letters never seen in training.
BETWEEN, UNKNOWN = 0, 1
UNDETERMINED = "und"


def training_texts(docs: DataFrame, usable: Column, lang: str = "lang", text: str = "text", key: str = "doc_id") -> dict[str, str]:
    """A bounded sample of each language's documents, whole texts: in order of a hash, so independent of their layout, as many as make PER_LANGUAGE characters.

    Documents of up to SHORT characters come first; longer ones, needed only where those don't suffice, by their lengths. The first document is learned
    however long it is. At most DOCUMENTS of a language are looked at. The sample is all that reaches the driver; a first pass over the
    labels tells what share of a language's documents is enough, so that only about four times as many are shuffled.
    """
    labelled = docs.filter(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    h = F.xxhash64(F.lit(6), F.col(key), F.col(text))
    labelled = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), h.alias("h"), F.length(text).alias("n"))
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return {}
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, 4 * DOCUMENTS / n) * (2**62))))])
    few = labelled.filter(F.pmod(F.col("h"), F.lit(2**62)) <= share[F.col("lang")])
    few = few.select("lang", "h", F.when(F.col("n") > SHORT, F.col("n")).otherwise(0).alias("long"), "text")
    order = Window.partitionBy("lang").orderBy("long", "h", "text")
    few = few.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= DOCUMENTS)
    few = few.withColumn("upto", F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("upto") <= PER_LANGUAGE) | (F.col("k") == 1))
    out: dict[str, str] = {}
    for r in few.orderBy("lang", "long", "h", "text").select("lang", "text").collect():
        out[r[0]] = out.get(r[0], "") + "\n" + r[1]
    return out


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The arcs of each state; state 0 is the root."""
    arcs: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(arcs)
        arcs.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in arcs[p]:
            arcs[p][c] = new
            p = link[p]
        if p >= 0:
            q = arcs[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(arcs)
                arcs.append(dict(arcs[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and arcs[p].get(c) == q:
                    arcs[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return arcs


class Arcs:
    """A language's automaton as a table: the next state by state and symbol, negated (less 1) where a phrase begins with the symbol.

    States here are multiples of the number of symbols. The root stands for a phrase just ended: every symbol begins one there.
    """

    def __init__(self, codes: np.ndarray, known: int):
        own = np.unique(codes)
        self.local = np.full(known, len(own), np.int32)  # a symbol that the language hasn't: no arc at all
        self.local[own] = np.arange(len(own))
        self.symbols = len(own) + 1
        arcs = suffix_automaton(self.local[codes].tolist())
        self.first = np.full(self.symbols, -1, np.int64)  # a symbol without an arc at the root is a phrase, and ends there
        for c, t in arcs[0].items():
            self.first[c] = -1 - t * self.symbols
        keys = np.fromiter((s * self.symbols + c for s, row in enumerate(arcs) if s for c in row), np.int64)
        to = np.fromiter((t * self.symbols for s, row in enumerate(arcs) if s for t in row.values()), np.int64)
        self.dense = None
        if len(arcs) * self.symbols <= DENSE:
            self.dense = np.tile(self.first.astype(np.int32), len(arcs))
            self.dense[keys] = to
        else:
            order = np.argsort(keys)
            self.keys, self.to = np.append(keys[order], np.iinfo(np.int64).max), np.append(to[order], 0)
        self.bits = float(np.log2(max(2, len(codes))))

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a symbol each, and whether a phrase begins with it."""
        if self.dense is not None:
            to = self.dense[state + symbol]
        else:
            at = np.searchsorted(self.keys, state + symbol)
            to = np.where(self.keys[at] == state + symbol, self.to[at], self.first[symbol])
        return to ^ (to >> (8 * to.itemsize - 1)), to < 0  # -1 - to where negative


class Parser:
    """All languages' automata."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        letters = sorted({c for t in texts.values() for c in t.lower() if c.isalpha()})
        self.code = np.full(0x110000, BETWEEN, np.int32)
        self.code[[c for c in range(0x110000) if chr(c).isalpha()]] = UNKNOWN
        self.code[[ord(c) for c in letters]] = np.arange(len(letters)) + 2
        self.arcs = [Arcs(self.codes(texts[lang]), len(letters) + 2) for lang in self.languages]

    def codes(self, text: str) -> np.ndarray:
        """Symbols of a text: lower-cased letters, and one BETWEEN for whatever stands between words."""
        c = self.code[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        return c[(c != BETWEEN) | (np.concatenate([[1], c[:-1]]) != BETWEEN)] if len(c) else c

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: phrases by language, its symbols, and whether it has a letter."""
        coded = [self.codes(t) for t in texts]
        lengths = np.array([len(c) for c in coded], np.int64)
        letter = np.array([bool((c != BETWEEN).any()) for c in coded], bool)
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        runs = -(-lengths // RUN)
        owner = np.repeat(np.arange(len(texts)), runs)
        if not len(owner) or not self.languages:
            return counts, lengths, letter
        number = np.concatenate([np.arange(n) for n in runs])
        size = np.minimum(RUN, lengths[owner] - number * RUN)
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        follows = np.full(len(order), -1)  # the run after each one, in the new order
        more = np.flatnonzero(number > 0)
        follows[place[more - 1]] = place[more]
        owner, size = owner[order], size[order]
        # a column for each run, so that a step reads a row
        flat = np.concatenate(coded)
        within = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        column = place[np.repeat(np.cumsum(runs) - runs, lengths) + within // RUN]
        laid = np.zeros((size[0], len(size)), np.int32)
        laid[within % RUN, column] = flat
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # runs that are at least so long
        for k, arcs in enumerate(self.arcs):
            symbols = arcs.local[laid]
            begins = np.zeros(laid.shape, bool)
            end = np.zeros(len(size), np.int32 if arcs.dense is not None else np.int64)
            for step, n in enumerate(live):
                end[:n], begins[step, :n] = arcs.step(end[:n], symbols[step, :n])
            found = begins.sum(axis=0)
            alone, todo = end.copy(), np.flatnonzero(follows >= 0)
            more = np.zeros(len(size), np.int64)
            while len(todo):
                run = follows[todo]
                more[run], after = self.again(arcs, symbols, begins, run, size[run], end[todo], alone[run])
                changed = after != end[run]
                end[run] = after
                todo = run[changed & (follows[run] >= 0)]
            counts[:, k] = np.bincount(owner, found + more, len(texts)).astype(np.int64)
        return counts, lengths, letter

    @staticmethod
    def again(arcs: Arcs, symbols: np.ndarray, begins: np.ndarray, run: np.ndarray, size: np.ndarray, state: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs read once more, from the states before them: how many more phrases begin there, and the states at their ends."""
        more, end = np.zeros(len(run), np.int64), end.copy()
        lane, step = np.arange(len(run)), 0
        while len(lane):
            before = begins[step, run[lane]]
            state, new = arcs.step(state, symbols[step, run[lane]])
            more[lane] += new.astype(np.int64) - before
            apart = ~(new & before)  # where both begin a phrase they are the same from there on
            step += 1
            last = apart & (step == size[lane])
            end[lane[last]] = state[last]
            apart &= ~last
            lane, state = lane[apart], state[apart]
        return more, end

    def entropies(self, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Cross entropies in bits a symbol."""
        return counts * np.array([a.bits for a in self.arcs]) / np.maximum(lengths, 1)[:, None]


def parser(texts: dict[str, str]) -> Parser:
    """This Python worker's automata for these texts, built once."""
    return held(("langid", hash(tuple(sorted(texts.items())))), lambda: Parser(texts))


def identify(docs: DataFrame, texts: dict[str, str], text: str = "text", names: Sequence[str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the learned language of least cross entropy, and how clearly (0 to 1).

    The score is the share of bits that the winner saves against the next language (1 if only one is learned).
    A text that is null or has no letter, and every text if nothing was learned, is ``und`` with score 0. Ties go to the
    language that sorts first. Whole texts are parsed; other columns stay, ones of the two ``names`` are replaced.
    """
    kept = [c for c in docs.columns if c not in names]
    rest = docs.select(*(F.col(f"`{c}`") for c in kept))
    held = docs.sparkSession.sparkContext.broadcast(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(held.value)
        for batch in batches:
            found_names, scores, pending = [], [], []
            size = 0
            found = batch.column(text).to_pylist()
            for i, t in enumerate(found):
                pending.append(t or "")
                size += len(t or "")
                if size < 2_000_000 and i + 1 < len(found):
                    continue
                counts, lengths, letter = p.phrases(pending)
                pending, size = [], 0
                bits = p.entropies(counts, lengths) if p.languages else counts
                if not p.languages:
                    letter[:] = False
                order = np.argsort(bits, axis=1, kind="stable")
                for row, by, ok in zip(bits, order, letter, strict=True):
                    found_names.append(p.languages[by[0]] if ok else UNDETERMINED)
                    scores.append(0.0 if not ok else 1.0 if len(by) < 2 else 1 - float(row[by[0]]) / float(row[by[1]]))
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(found_names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, *names])

    schema = rest.withColumns({names[0]: F.lit("").cast("string"), names[1]: F.lit(0.0)}).schema
    return rest.mapInArrow(run, schema)

"""BPE encoding and decoding with a tokenization automaton.

The merges of a byte-level vocabulary with word ends are compiled, one merge after the other, into
a deterministic automaton whose arcs are tokens. Before the first merge there is one state, which
every base symbol leads back to. The gadget of merge number k, (u, v) -> uv, does this:

* every arc labelled u now leads to a new state: a copy of its old target that v no longer leaves;
* uv leads from wherever u did to where v leads.

All arcs with one label lead to one state, so a state is known by the label that enters it, and it
differs from its predecessor only in what it blocks. What v's removal blocks is v itself and every
token whose leftmost descent passes v and would take v up only at merge k or later (uv, made
from a u that v can still follow, is among the others). Numbering tokens in preorder of the
"left part" tree, children with the latest merges first, makes that a contiguous interval; a state is
then a chain of intervals, and a transition one binary search. A word has exactly one path through
the automaton that spells it; its arc labels are the tokens.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import held

#: Fixed values of the tokenizer format: the white space it replaces, and its word pattern.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: The same for lower-cased text of ASCII or Latin-1 alone, where plain ranges say it.
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
LATIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
SEPARATOR = re.compile("[\x1c-\x1f]")
#: Stands for the end-of-word mark while a word is spelt: the symbol after the bytes.
END = 256
#: Bytes that one Python worker spends on remembered words at most: some 190 for an ordinary one, PLACE beside the word and its ids; transitions it keeps at hand (a power of two).
REMEMBERED, PLACE, ARCS = 100_000_000, 120, 1 << 20
#: Bytes of a word from which on it is read alone.
LONG = 200


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Automaton:
    """Compiled from a tokenizer's JSON: states, arcs and the tables that spell the arcs' labels."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self._compile(vocab, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self._spell(vocab)
        self._cut: dict[int, tuple[list[int], list[int]]] = {}
        self.met, self.free = np.full(ARCS, -1, np.int64), np.zeros(ARCS, bool)

    def _compile(self, vocab: dict[str, int], merges: list[tuple[int, int, int]]) -> None:
        parts = {t: (u, v, k) for k, (u, v, t) in enumerate(merges)}
        grown: dict[int, list[tuple[int, int]]] = {}  # left part: (merge, token), earliest first
        for t, (u, _, k) in sorted(parts.items(), key=lambda x: x[1][2]):
            grown.setdefault(u, []).append((k, t))
        self.order: dict[int, int] = {}
        last: dict[int, int] = {}
        n = 0
        for root in (t for t in vocab.values() if t not in parts):
            todo = [(root, False)]
            while todo:
                t, left = todo.pop()
                if left:
                    last[t] = n
                    continue
                self.order[t] = n
                n += 1
                todo.append((t, True))
                todo += [(c, False) for _, c in grown.get(t, [])]  # popped from the latest merge on
        rank = {(u, v): k for k, (u, v, _) in enumerate(merges)}

        def parted(u: int, v: int, before: int) -> bool:
            """Whether an earlier gadget already took v from the state that u enters."""
            x, x_until = u, before
            while True:
                y, y_until = v, before
                while True:
                    k = rank.get((x, y), before)
                    if k < x_until and (k < before and k <= y_until):
                        return True
                    if y not in parts:
                        break
                    y, _, y_until = parts[y]
                if x not in parts:
                    return False
                _, x, x_until = parts[x]

        #: A state blocks [low, high) and what its parent blocks; state 0 blocks nothing.
        self.parent, self.low, self.high = [0], [0], [0]
        self.enters = dict.fromkeys((t for t in vocab.values() if t not in parts), 0)
        for k, (u, v, t) in enumerate(merges):
            if u not in self.enters or v not in self.enters or parted(u, v, k):
                continue  # no path reads u and then v: the gadget has nothing to join
            target = self.enters[v]
            younger = grown.get(v, [])
            at = bisect_left(younger, (k, -1))
            self.parent.append(self.enters[u])
            self.low.append(self.order[v])
            self.high.append(self.order[younger[at - 1][1]] if at else last[v])
            self.enters[u] = len(self.parent) - 1
            self.enters[t] = target

    def _spell(self, vocab: dict[str, int]) -> None:
        """Tables that spell the labels by bytes and END: the next node by node and symbol, and the token that ends at a node (-1: none)."""
        number = {c: b for b, c in enumerate(byte_symbols())}
        labels = []
        for label, t in vocab.items():
            if t in self.enters:
                marked = self.end and label.endswith(self.end) and len(label) > len(self.end)
                labels.append(([number[c] for c in (label[: -len(self.end)] if marked else label)] + [END] * bool(marked), t))
        rows: dict[tuple[int, int], int] = {}
        self.ends: dict[int, int] = {}  # how many symbols each label spells
        last = {}
        for symbols, t in labels:
            node = 0
            for c in symbols:
                node = rows.setdefault((node, c), len(rows) + 1)
            last[node] = t
            self.ends[t] = len(symbols)
        # nodes with branches come first, so that only they have a row of the table; the others share an empty one
        branching = {k[0] for k in rows} | {0}
        order = [0, *sorted(branching - {0}), *sorted({*rows.values()} - branching)]
        place = np.empty(len(rows) + 1, np.int32)
        place[order] = np.arange(len(order))
        self.rows = len(branching)
        self.next = np.zeros((self.rows + 1, END + 2), np.int32)
        for (node, c), to in rows.items():
            self.next[place[node], c] = place[to]
        self.token = np.full(len(order), -1, np.int32)
        for node, t in last.items():
            self.token[place[node]] = t
        self.longest = max(self.ends.values(), default=1)
        self.width = np.zeros(max(vocab.values(), default=0) + 1, np.int32)
        self.width[[*self.ends]] = [*self.ends.values()]
        self.state_of = np.zeros(len(self.width), np.int64)
        self.state_of[[*self.enters]] = [*self.enters.values()]

    def blocked(self, state: int) -> tuple[list[int], list[int]]:
        """The state's blocked intervals, merged and sorted; worked out when first needed."""
        if state not in self._cut:
            spans, at = [], state
            while at:
                spans.append((self.low[at], self.high[at]))
                at = self.parent[at]
            lows: list[int] = []
            highs: list[int] = []
            for a, b in sorted(spans):
                if highs and a <= highs[-1]:
                    highs[-1] = max(highs[-1], b)
                else:
                    lows.append(a)
                    highs.append(b)
            self._cut[state] = lows, highs
        return self._cut[state]

    def word(self, symbols: bytes) -> list[int]:
        """The arc labels of the one path that spells a word, given in bytes.

        At each place the arcs that spell what follows are tried, the longest first. Where none is left the last step is
        taken back and remembered as dead, so each token is tried once at each place: time grows with the word's length.
        """
        n = len(symbols)
        spelt = [*symbols, END] if self.end else [*symbols]
        split = n if self.end else -1  # the last symbol and its end mark are one
        out: list[int] = []
        path: list[tuple[int, list[int]]] = []  # each place and what else could have come there
        dead: set[tuple[int, int]] = set()
        at = state = 0
        while True:
            options: list[int] = []
            node = 0
            for i in range(at, min(at + self.longest, len(spelt))):
                node = int(self.next[min(node, self.rows), spelt[i]])
                if not node:
                    break
                if self.token[node] >= 0 and i + 1 != split:
                    options.append(int(self.token[node]))
            while True:
                while not options:
                    if not path:
                        raise ValueError(f"no path spells {symbols!r}")
                    dead.add((at, out.pop()))
                    at, options = path.pop()
                    state = self.enters[out[-1]] if out else 0
                t = options.pop()
                if (at + self.ends[t], t) not in dead and (not state or self.arc(state << 20 | t)):
                    break
            out.append(t)
            path.append((at, options))
            at += self.ends[t]
            if at >= n:
                return out
            state = self.enters[t]

    def words(self, words: list[bytes]) -> list[bytes]:
        """The paths of many words as little-endian unsigned 32-bit labels, by table, all words at once.

        As each beginning of a word has one path too, every place is entered by one arc: the longest label ending there
        that the state at its start has an arc for. Words of more than LONG bytes are left to ``word``.
        """
        out = [b""] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG]
        for at in range(0, len(short), 8192):
            part = sorted(short[at : at + 8192], key=lambda i: -len(words[i]))
            for i, path in zip(part, self._paths([words[i] for i in part]), strict=True):
                out[i] = path
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = np.array(self.word(w), "<u4").tobytes()
        return out

    def _paths(self, words: list[bytes]) -> list[bytes]:
        """The same for words of 1 to LONG bytes, the longest first."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        start = np.arange(len(words)) * 2 + np.cumsum(size) - size
        own = np.arange(len(text)) + np.repeat(np.arange(len(words)) * 2, size)
        spelt = np.full(len(text) + 2 * len(words) + 1, END + 1, np.int32)  # END + 1 has no branch
        spelt[own] = text
        if self.end:
            spelt[start + size] = END
        # the label of each length that ends at each place, whatever comes before
        ending: list[np.ndarray] = []
        node, at = np.zeros(len(own), np.int32), own
        while len(at):
            node = self.next[np.minimum(node, self.rows), spelt[at]]
            on = node > 0
            node, at = node[on], at[on] + 1
            found = np.full(len(spelt), -1, np.int32)
            found[at] = self.token[node]
            ending.append(found)
        state, entered = np.full(len(spelt), -1, np.int64), np.full(len(spelt), -1, np.int32)
        state[start] = 0
        last = size + 1 if self.end else size
        for step in range(1, int(last[0]) + 1):
            lanes = int(np.searchsorted(-last, -step, "right"))
            place = start[:lanes] + step
            if self.end:
                place = place[step != size[:lanes]]  # the last symbol and its end mark are one
            option = np.array([found[place] for found in ending[:step][::-1]])  # longest first
            open_ = np.arange(len(place))
            while len(open_):
                k = (option[:, open_] >= 0).argmax(0)
                t = option[k, open_]
                some = t >= 0
                open_, k, t = open_[some], k[some], t[some]
                before = state[place[open_] - (len(option) - k)]
                free = before == 0
                asked = np.flatnonzero(before > 0)
                free[asked] = self._has(before[asked] << 20 | t[asked])
                here = place[open_[free]]
                entered[here] = t[free]
                state[here] = self.state_of[t[free]]
                option[k, open_] = -1
                open_ = open_[~free]
        lane, at = np.arange(len(words)), start + last
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(lane):
            t = entered[at]
            if (t < 0).any():
                raise ValueError(f"no path spells {words[int(lane[t < 0][0])]!r}")
            steps.append((lane, t))
            at = at - self.width[t]
            on = at > start[lane]
            lane, at = lane[on], at[on]
        lanes = np.concatenate([s[0] for s in reversed(steps)])
        order = np.argsort(lanes, kind="stable")
        packed = np.concatenate([s[1] for s in reversed(steps)])[order].astype("<u4").tobytes()
        cut = (np.searchsorted(lanes[order], np.arange(len(words) + 1)) * 4).tolist()
        return [packed[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def _has(self, arcs: np.ndarray) -> np.ndarray:
        """Whether the states have these arcs (state << 20 | token), by a table of those met before."""
        place = (arcs * 0x9E3779B1 >> 7) & (len(self.met) - 1)
        new = np.flatnonzero(self.met[place] != arcs)
        if len(new):
            found, inverse = np.unique(arcs[new], return_inverse=True)
            free = np.fromiter(map(self.arc, found.tolist()), bool, len(found))
            out = self.free[place]
            out[new] = free[inverse]
            self.met[place[new]], self.free[place[new]] = arcs[new], out[new]
            return out
        return self.free[place]

    def arc(self, arc: int) -> bool:
        """Whether a state has an arc: its label, by number, isn't in one of the blocked intervals."""
        lows, highs = self.blocked(arc >> 20)
        x = self.order[arc & 0xFFFFF]
        k = bisect_right(lows, x)
        return not k or x >= highs[k - 1]


class Numbers(dict):
    """Numbers what it is asked for, as it comes; ``new`` are those numbered since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str | tuple[str]] = []

    def __missing__(self, key: str | tuple[str]) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Encoder:
    """Texts to ids (little-endian unsigned 32-bit numbers), remembering the paths of what stands between white space.

    What is met is numbered, and its path lies in one array of ids; a batch is looked up word by word once, and its ids are gathered by number. When more than REMEMBERED
    bytes are taken, only what the last batch met is kept, so frequent words stay.
    """

    def __init__(self, path: str):
        self.automaton = Automaton(path)
        self.number = Numbers()
        self.starts = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint32)
        self.last = np.empty(0, np.int64)
        self.taken = 0

    def _learn(self, new: list[str | tuple[str]]) -> None:
        """The paths of ``new``, numbered last and in this order, and of the words that they consist of; a tuple is a special token."""
        known = len(self.starts) - 1
        mixed: dict[str, list[str]] = {}
        for c in new:
            if isinstance(c, str) and not c.isalpha():
                found = [c[:-1], c[-1]] if c[-1] in ".,;:" and c[:-1].isalpha() else words_of(c)
                if found != [c]:
                    mixed[c] = found
        number = self.number
        inner = {c: [number[w] for w in found] for c, found in mixed.items()}  # numbers words that are new
        new, number.new = new + number.new, []
        words = [c for c in new if c not in mixed and isinstance(c, str)]
        paths: list[bytes] = []
        for at in range(0, len(words), 16384):
            paths += self.automaton.words([w.encode() for w in words[at : at + 16384]])
        own = iter(paths)
        found = [None if c in mixed else next(own) if isinstance(c, str) else struct.pack("<I", self.automaton.special[c[0]]) for c in new]

        def path(n: int) -> bytes:
            return found[n - known] if n >= known else self.ids[self.starts[n] : self.starts[n + 1]].tobytes()

        for c, parts in inner.items():
            found[number[c] - known] = b"".join([path(n) for n in parts])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) // 4 for x in found])])
        self.taken += sum(map(sys.getsizeof, new)) + sum(map(len, found)) + PLACE * len(new)

    def _forget(self) -> None:
        """Keep only what the last batch met."""
        words = [*self.number]
        sizes = self.starts[self.last + 1] - self.starts[self.last]
        self.ids = self.ids[runs(sizes) + np.repeat(self.starts[self.last], sizes)]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.number = Numbers()
        self.number |= {words[i]: k for k, i in enumerate(self.last.tolist())}
        self.taken = sum(map(sys.getsizeof, self.number)) + self.ids.nbytes + PLACE * len(self.number)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; nulls and empty texts have none."""
        special = self.automaton.special_pattern
        if self.taken > REMEMBERED:
            self._forget()
        number, sizes, numbers = self.number.__getitem__, [], []
        for text in texts:
            if not text:
                chunks: list[str | tuple[str]] = []
            elif special is None or not special.search(text):
                chunks = chunks_of(text)
            else:
                at, chunks = 0, []
                for m in special.finditer(text):
                    chunks += [*chunks_of(text[at : m.start()]), (m[0],)]
                    at = m.end()
                chunks += chunks_of(text[at:])
            sizes.append(len(chunks))
            numbers.append(np.fromiter(map(number, chunks), np.int64, len(chunks)))
        if self.number.new:
            new, self.number.new = self.number.new, []
            self._learn(new)
        found = np.concatenate(numbers) if numbers else self.last[:0]
        self.last = np.unique(found)
        lengths = self.starts[found + 1] - self.starts[found]
        ids = self.ids[runs(lengths) + np.repeat(self.starts[found], lengths)].astype("<u4").tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])] * 4
        return [ids[a:b] for a, b in pairwise(ends.tolist())]


def runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of ``counts``, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def chunks_of(text: str) -> list[str]:
    """What stands between white space in the normalised text."""
    low = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    if SEPARATOR.search(low):  # split() takes these for white space, the tokenizer doesn't
        return words_of(low)
    return low.split()


def words_of(low: str) -> list[str]:
    return (ASCII_WORD if low.isascii() else LATIN_WORD if max(low) <= "ÿ" else WORD).findall(low)


def encoder(path: str) -> Encoder:
    """This Python worker's encoder for a vocabulary file; compiled once, kept between tasks."""
    return held(("bpe", path), lambda: Encoder(path))


def token_batches(batches: Iterator[pa.RecordBatch], path: str, text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch in slices of about 4 MB of text, with the ids of its rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.cast(pc.binary_length(batch.column(text)), pa.int64()), 0).to_numpy()
        slices = np.cumsum(sizes) // 4_000_000
        at = 0
        for n in np.bincount(slices)[np.unique(slices)]:
            part = batch.slice(at, int(n))
            yield part, encoder(path).encode(part.column(text).to_pylist())
            at += int(n)


def id_lists(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with ``ids``: the token ids of the whole of ``text``; with ``decoded``, if named: what ``decode`` makes of them, in the same pass.

    A null or empty text has an empty list. A column named as ``ids`` or ``decoded`` is replaced (also the text itself, which then
    doesn't travel back); other columns stay as they are. Rows are independent: no shuffle, repeated rows give repeated results.
    """
    made = [ids] if decoded is None else [ids, decoded]
    kept = [c for c in docs.columns if c not in made]
    rest = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c in kept or c == text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in token_batches(batches, path, text):
            lists = id_lists(found)
            own = [lists] if decoded is None else [lists, texts_of(lists, labels_of(path))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *own], names=[*kept, *made])

    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).withColumn(ids, F.lit(None).cast("array<int>"))
    return rest.mapInArrow(run, (schema if decoded is None else schema.withColumn(decoded, F.lit(None).cast("string"))).schema)


#: The last vocabulary's labels in this Python worker: some MB, apart from the encoder's tables, so that a worker that decodes doesn't lose them.
_LABELS: dict[str, pa.StringArray] = {}


def labels_of(path: str) -> pa.StringArray:
    """The label of each id in a vocabulary file, by id; null where there is none, and at the end. Kept between tasks."""
    if path not in _LABELS:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        found = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        _LABELS.clear()
        _LABELS[path] = pa.array([found.get(i) for i in range(max(found, default=-1) + 2)], pa.string())
    return _LABELS[path]


def texts_of(ids: pa.ListArray, labels: pa.StringArray) -> pa.StringArray:
    """The labels of each list's ids, joined by a space; ids without a label are left out, null lists are empty."""
    none = len(labels) - 1
    flat = pc.fill_null(pc.cast(ids.flatten(), pa.int64()), none).to_numpy()
    names = labels.take(pa.array(np.where((flat >= 0) & (flat < none), flat, none)))
    named = np.concatenate([[0], np.cumsum(names.is_valid().to_numpy(zero_copy_only=False))])
    ends = named[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.drop_null()), " ")


def decode(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with ``decoded``: the labels of the arcs that ``ids`` name, joined by a space.

    That is how the vocabulary's own library writes ids back where the file names no decoder. A null list
    gives the empty text; ids without an arc are left out.
    """
    kept = [c for c in docs.columns if c != decoded]
    rest = docs.select(*(F.col(f"`{c}`") for c in kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = labels_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, texts_of(part.column(ids), labels)], names=[*kept, decoded])

    return rest.mapInArrow(run, rest.withColumn(decoded, F.lit(None).cast("string")).schema)


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)

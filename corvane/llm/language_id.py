"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text is built for each language. A text is parsed against each of them
into longest matches: from the root, follow the automaton while it matches; a failure ends a phrase, and what failed starts the next
one, or is a phrase of its own where the training text does not have it at all. The estimate of the cross entropy is
phrases * log2(length of the training text) / length of the text, and the language that needs the fewest such normalised
phrases wins (ties: the smallest name).

Texts are sequences of UTF-8 bytes of their lower-cased letters and marks; whatever else is a separator, and runs of separators
count once. So every script has a small alphabet, that of its own training text. Texts are parsed whole: blocks of a text
are parsed at once from the root, then each again from the state in which the block before has ended, until both are in the same state.

A text that is null or has no letter gets `und` and score 0. Training takes a bounded sample of rows: of each language the ROWS whole
texts with the smallest hash of their id and text; texts over LONG characters are taken only if there are not enough others. A null language or text does
not train; repeated rows may fill the sample. An empty table gives an empty one. Other columns are kept, except those named lang_pred or
score in any case, which are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import append, quoted

ROWS, LONG = 24, 20_000
#: Bytes parsed at once, and bytes of texts in a slice.
BLOCK, SLICE = 256, 1 << 20
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def sample(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS) -> dict[str, str]:
    """Training text of each language: at most rows whole texts."""
    usable = docs.where(train & F.col(quoted(lang)).isNotNull() & F.col(quoted(text)).isNotNull())
    keyed = usable.select(F.col(quoted(lang)).cast("string").alias("lang"), F.xxhash64(quoted(doc_id), quoted(text)).alias("h"), (F.length(quoted(text)) > LONG).alias("long"), F.col(quoted(text)).alias("t"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", "h", "t"))
    by: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for r in keyed.withColumn("r", rank).where(F.col("r") <= rows).collect():  # at most rows rows a language
        by[r.lang].append((r.r, r.t))
    return {name: "\n".join(t for _, t in sorted(found)) for name, found in by.items()}


def letters(text: str) -> bytes:
    """Lower-cased letters and marks in UTF-8, with one blank for all else between them."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


def automaton(codes: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Parser:
    """All automata as one table: entry [state, byte] has the place of the next state's row and, in two bits, the phrases that end.

    Each language has codes for the bytes of its own training text; code 0 is any other byte, a phrase of its own.
    """

    def __init__(self, texts: dict[str, str], block: int = BLOCK) -> None:
        self.names, self.block = sorted(texts), block
        tables, roots, bits, at = [], [], [], 0
        self.code = np.zeros((len(self.names), 256), np.uint8)
        for k, name in enumerate(self.names):
            raw = letters(texts[name])
            used = sorted(set(raw))
            self.code[k, used] = np.arange(1, len(used) + 1)
            states, width = automaton(raw), len(used) + 1
            bits.append(np.log2(max(len(raw), 2)))
            owner = np.repeat(np.arange(len(states)), [len(moves) for moves in states])
            byte, to = (np.fromiter(chain.from_iterable(x), np.int64, len(owner)) for x in (states, (moves.values() for moves in states)))
            table = np.full((len(states), width), -1, np.int64)
            table[owner, self.code[k, byte]] = at + to * width
            fresh = np.ones((len(states), 1), np.int64)
            fresh[0] = 0  # at the root no phrase has begun
            start = table[0]
            again = np.where(start >= 0, start << 2, (at << 2) + 1)[None, :] + fresh
            tables.append(np.where(table >= 0, table << 2, again).ravel())
            roots.append(at)
            at += table.size
        self.bits, self.roots = np.array(bits), np.array(roots, np.int64)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int64)
        if at < 1 << 29:
            self.table = self.table.astype(np.int32)

    def _step(self, codes: np.ndarray, state: np.ndarray, ended: np.ndarray) -> None:
        got = self.table[state + codes]
        ended += got & 3
        np.right_shift(got, 2, out=state, casting="unsafe")

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text for each language, and each text's bytes."""
        raw = [letters(t) for t in texts]
        sizes = np.array([len(r) for r in raw], np.int64)
        blocks = -(-sizes // self.block)
        owner = np.repeat(np.arange(len(texts)), blocks)
        length = np.full(len(owner), self.block, np.int64)
        ends = np.cumsum(blocks)[blocks > 0] - 1
        length[ends] = (sizes - (blocks - 1) * self.block)[blocks > 0]
        padded = np.zeros((len(owner), self.block), np.uint8)
        padded[np.arange(self.block) < length[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
        order = np.argsort(-length, kind="stable")  # the blocks at work are always the first
        matrix = np.ascontiguousarray(padded[order].T)
        counts = np.zeros((len(self.names), len(texts)), np.int64)
        for k in range(len(self.names)):
            counts[k] = np.bincount(owner, self._parse(k, matrix, order, owner, length, ends), len(texts)).astype(np.int64)
        return counts, sizes

    def _parse(self, k: int, matrix: np.ndarray, order: np.ndarray, owner: np.ndarray, length: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases that end in each block, for one language; the end of a text ends its last one."""
        n, root = len(owner), self.roots[k]
        codes = self.code[k][matrix]
        at_work = np.searchsorted(-length[order], -np.arange(len(codes)), side="left").tolist()
        state, ended = np.full(n, root, np.int64), np.zeros(n, np.int64)
        for row, m in zip(codes, at_work, strict=True):
            self._step(row[:m], state[:m], ended[:m])
        place, alone, count = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
        place[order], alone[order], count[order] = np.arange(n), state, ended
        # each block again from where the one before has ended, beside the run from the root, until both are in one state
        last, more = alone.copy(), np.zeros(n, np.int64)
        todo = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        while len(todo):
            carried, fresh, differ = last[todo - 1], np.full(len(todo), root, np.int64), np.zeros(len(todo), np.int64)
            live = np.flatnonzero(carried != fresh)
            for i in range(len(codes)):
                live = live[(carried[live] != fresh[live]) & (length[todo[live]] > i)]
                if not len(live):
                    break
                row = codes[i, place[todo[live]]]
                one, other, n_one, n_other = carried[live], fresh[live], np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
                self._step(row, one, n_one)
                self._step(row, other, n_other)
                carried[live], fresh[live] = one, other
                differ[live] += n_one - n_other
            more[todo] = differ
            now = np.where(carried == fresh, alone[todo], carried)
            changed = todo[now != last[todo]] + 1
            last[todo] = now
            changed = changed[changed < n]
            todo = changed[owner[changed] == owner[changed - 1]]
        count += more
        count[ends] += last[ends] != root
        return count

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and self.names and _LETTER.search(t)]
        if known:
            counts, sizes = self.phrases([texts[i] for i in known])
            cost = counts * self.bits[:, None] / np.maximum(sizes, 1)
            best = cost.argmin(axis=0)
            share = 2.0 ** -(np.minimum(cost - cost.min(axis=0), 60))
            for i, b, s in zip(known, best, 1 / share.sum(axis=0), strict=True):
                names[i], scores[i] = self.names[b], s
        return names, scores


_BUILT: dict[tuple, Parser] = {}


def _parser(texts: dict[str, str]) -> Parser:
    key = tuple(sorted(texts.items()))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Parser(texts)
    return _BUILT[key]


def predict(docs: DataFrame, texts: dict[str, str], text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the share of the winner if each language weighs 2 ** -entropy."""
    shipped = docs.sparkSession.sparkContext.broadcast(texts)  # a bounded number of rows a language

    def make():
        parser = _parser(shipped.value)

        def step(piece):
            names, scores = parser.predict(piece.column(text).to_pylist())
            return [pa.array(names, pa.string()), pa.array(scores)]

        return step

    return append(docs, text, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], SLICE)

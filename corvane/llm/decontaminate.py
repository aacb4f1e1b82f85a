"""Benchmark decontamination: a prefix-filtered join of documents with windows of benchmark items.

Every item is cut into windows of consecutive words (an item shorter than a window is one window).
Words are ordered by how rare they are in the documents, counted over all of them. Containment is
whole, so the necessary prefix of a window is its rarest word alone: a document is probed only where
it has such a word. A hit must leave room for the window on both sides (positional and length
bounds), and then all words of the window are compared.

Windows that end anywhere in a document count. Null and empty texts have no words and are never hit;
items without words, or with a null id, take no part; items with the same id are one item. Repeated
documents are judged alike. Very long texts are taken whole, one at a time. The item windows are sent to executors in slices of bounded size; after each
slice but the last the documents are written with what was found so far, and its index goes. So a larger benchmark
costs passes over the documents, and not memory or shuffles. An empty table gives an empty one; columns of docs
with the names of results are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import append, as_bytes, drop_stored, explode, schema, stored

WINDOW = 10
#: Bytes of item text in one slice; the index of one has some 75 times as many.
SLICE_CHARS = 2 << 20
#: Candidate places compared at once.
AT_ONCE = 200_000

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all that is not ASCII."""
    return text.translate(_FOLD).split() if text else []


def _item_slices(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in slices of at most limit characters (at least one item each), read a partition at a time."""
    piece, size = [], 0
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).where("i is not null and t is not null")
    for i, t in rows.toLocalIterator():
        if piece and size + len(t) > limit:
            yield piece
            piece, size = [], 0
        piece.append((i, bytes(t)))
        size += len(t)
    if piece:
        yield piece


class Windows:
    """The distinct windows of some items, indexed by their rarest word."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            for at in range(max(len(codes) - window, 0) + 1) if codes else ():
                owners[tuple(codes[at : at + window])].add(item)
        self.codes = list(owners)
        self.owners = [sorted(x) for x in owners.values()]

    def index(self, counts: np.ndarray) -> None:
        """counts: how often each word occurs in the documents."""
        rows = []
        for k, codes in enumerate(self.codes):
            at = min(range(len(codes)), key=lambda j: (counts[codes[j]], codes[j], j))
            rows.append((codes[at], at, len(codes), k))
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 4)
        self.at, self.length, self.which = table[:, 1], table[:, 2], table[:, 3]
        self.first = np.searchsorted(table[:, 0], np.arange(len(self.vocabulary) + 1))
        self.width = int(self.length.max(initial=1))
        self.matrix = np.full((len(self.codes), self.width), -2, np.int32)
        for k, codes in enumerate(self.codes):
            self.matrix[k, : len(codes)] = codes

    def code(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, tokens, repeat(-1)), np.int32, len(tokens))

    def find(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts and numbers of the windows that occur in a document."""
        n = len(codes)
        places = np.flatnonzero(codes >= 0)
        entries = self.first[codes[places] + 1] - self.first[codes[places]]
        places, entries = places[entries > 0], entries[entries > 0]
        ends = np.cumsum(entries)
        done = 0
        while done < len(places):
            stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + AT_ONCE)))
            p, e = places[done:stop], entries[done:stop]
            done = stop
            inner = np.arange(e.sum()) - np.repeat(np.cumsum(e) - e, e)
            entry = np.repeat(self.first[codes[p]], e) + inner
            start = np.repeat(p, e) - self.at[entry]
            fits = (start >= 0) & (start + self.length[entry] <= n)
            start, entry = start[fits], entry[fits]
            for j in range(self.width):
                wanted = self.matrix[self.which[entry], j]
                same = (wanted == -2) | (codes[np.minimum(start + j, n - 1)] == wanted)
                start, entry = start[same], entry[same]
            if len(start):
                yield start, self.which[entry]


def _word_counts(docs: DataFrame, text: str, vocabulary) -> np.ndarray:
    """How often each word of the vocabulary occurs in all documents."""

    def make():
        known = vocabulary.value

        def step(piece):
            total = np.zeros(len(known) + 1, np.int64)
            for t in as_bytes(piece.column(text)):
                tokens = words(t)
                total += np.bincount(np.fromiter(map(known.get, tokens, repeat(len(known))), np.int64, len(tokens)), minlength=len(known) + 1)
            seen = np.flatnonzero(total[:-1])
            return [pa.array(seen), pa.array(total[seen])] if len(seen) else None

        return step

    rows = explode(docs.select(text), text, make, schema("word long, n long")).groupBy("word").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(vocabulary.value), np.int64)
    for word, n in rows.collect():  # at most the words of one slice of items
        counts[word] = n
    return counts


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """docs with n_words, hit_spans (array of the start and end of each maximal run of hit words) and items (ids, sorted)."""
    spans_type = T.ArrayType(T.LongType())
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", spans_type), T.StructField("items", T.ArrayType(T.StringType()))]
    sc = docs.sparkSession.sparkContext
    out = docs.drop("n_words", "hit_spans", "items")
    shipped = before = None
    for part in _item_slices(items, item_id, item_text, slice_chars):
        if shipped is not None:
            done = stored(out)
            shipped.destroy()
            if before is not None:
                drop_stored(before)
            out = before = done
        found = Windows(part, window)
        vocabulary = sc.broadcast(found.vocabulary)
        found.index(_word_counts(docs, text, vocabulary))
        vocabulary.destroy()
        first, shipped = shipped is None, sc.broadcast(found)
        out = append(out, text, _step(text, shipped, first), fields)
    if shipped is None:
        out = append(out, text, _step(text, sc.broadcast(None), True), fields)
    return out


def _step(text: str, windows, first: bool):
    def make():
        found = windows.value

        def step(piece):
            texts = as_bytes(piece.column(text))
            spans0 = [[]] * len(texts) if first else piece.column("hit_spans").to_pylist()
            items0 = [[]] * len(texts) if first else piece.column("items").to_pylist()
            n_words, spans, items = [], [], []
            for t, old_spans, old_items in zip(texts, spans0, items0, strict=True):
                tokens = words(t)
                n_words.append(len(tokens))
                hits = list(found.find(found.code(tokens))) if found is not None and tokens else []
                if not hits:
                    spans.append(old_spans)
                    items.append(old_items)
                    continue
                edge = np.zeros(len(tokens) + 1, np.int64)
                which = set()
                for start, k in hits:
                    np.add.at(edge, start, 1)
                    np.subtract.at(edge, start + [len(found.codes[i]) for i in k], 1)
                    which.update(k.tolist())
                if old_spans:
                    np.add.at(edge, old_spans[::2], 1)
                    np.subtract.at(edge, old_spans[1::2], 1)
                covered = np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8)
                spans.append(np.flatnonzero(np.diff(covered)).tolist())
                items.append(sorted(set(old_items).union(*(found.owners[i] for i in which))))
            return [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]

        return step

    return make

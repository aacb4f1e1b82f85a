"""Byte-level BPE encoding and decoding.

A text is cut into pre-tokens by a pattern. A pre-token that is a whole vocabulary entry is resolved
by a minimal perfect hash; any other is merged from its bytes, a doubly linked list whose adjacent
pairs wait in a heap by rank. Ids equal those of the public reference tokenizer without special tokens.

Null and empty texts have no ids and decode to no bytes. Repeated rows are encoded alike; a very long text is
handled alone; an empty table gives an empty one. Other columns are kept, except one named as an output in any case, which is replaced.
"""

from __future__ import annotations

import base64
import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corvane.llm.common import append, map_arrow

#: Resolved pre-tokens that a worker remembers in each of two generations.
REMEMBERED = 150_000
#: Ids decoded at once, and those of one more text.
DECODED = 1 << 20
_MASK = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings: levels of bit arrays, then rank.

    A key takes the slot of the first level where no other remaining key falls; its number is the
    count of taken slots before it. index() gives a number for a foreign key too, so callers compare.
    """

    def __init__(self, keys: list[bytes], spread: float = 2.0) -> None:
        left = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        before = 0
        while len(left):
            size = max(64, int(len(left) * spread))
            slot = self._slots(left, len(self.levels), size)
            taken = np.bincount(slot, minlength=size) == 1
            self.levels.append((size, taken, before + np.cumsum(taken) - taken))
            before += int(taken.sum())
            left = left[~taken[slot]]
            if len(self.levels) > 60:
                raise ValueError("keys are not distinct")
        self.size = before

    @staticmethod
    def _slots(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = (hashes ^ np.uint64((level * _ODD) & _MASK)) * np.uint64(_ODD)
        return ((mixed >> np.uint64(29)) % np.uint64(size)).astype(np.int64)

    def index(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        for level, (size, taken, rank) in enumerate(self.levels):
            slot = ((((h ^ (level * _ODD & _MASK)) * _ODD) & _MASK) >> 29) % size
            if taken[slot]:
                return int(rank[slot])
        return -1


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: merge the adjacent pair of the lowest rank, the leftmost first, until none is left."""
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if middle < 0 or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, -1
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Tokenizer:
    """Two-tier encoder; resolved pre-tokens are remembered as the bytes of their ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED) -> None:
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.hash = PerfectHash(list(ranks))
        self.entries: list[bytes] = [b""] * self.hash.size
        self.ids = [0] * self.hash.size
        for token, rank in ranks.items():
            at = self.hash.index(token)
            self.entries[at], self.ids[at] = token, rank
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.bytes_of.append(b"")  # at -1, for a null id
        self.known = _Memory(self.resolve, remembered)

    def resolve(self, piece: str) -> bytes:
        raw = piece.encode()
        at = self.hash.index(raw)
        ids = [self.ids[at]] if at >= 0 and self.entries[at] == raw else merge(raw, self.ranks)
        return np.array(ids, np.int32).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as consecutive 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.split(text)))


class _Memory(dict):
    """Remembers results in two generations; the older one goes when the newer is full."""

    def __init__(self, resolve, limit: int) -> None:
        super().__init__()
        self.resolve, self.limit, self.older = resolve, limit, {}

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def __missing__(self, key):
        if (value := self.older.get(key)) is None:
            value = self.resolve(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


_LOADED: dict[tuple[bytes, str], Tokenizer] = {}


def _tokenizer(raw: bytes, pattern: str) -> Tokenizer:
    key = (xxhash.xxh3_128_digest(raw), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}, pattern)
    return _LOADED[key]


def _shipped(df: DataFrame, path: str):
    """The vocabulary file, read on the driver and sent to the executors; its size is fixed."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """df and an array<int> of the ids of each whole text."""
    raw = _shipped(df, path)

    def make():
        tokenizer = _tokenizer(raw.value, pattern)

        def step(piece):
            packed = [tokenizer.encode(t) if t else b"" for t in piece.column(text).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)  # a slice has fewer than 2 ** 31 bytes
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))]

        step.close = tokenizer.known.forget
        return step

    return append(df, text, make, [T.StructField(out, T.ArrayType(T.IntegerType()))])


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df and the bytes that each array of ids stands for; null arrays and null ids give no bytes."""
    raw = _shipped(df, path)
    kept = [i for i, n in enumerate(df.columns) if n.lower() != out.lower()]
    result = T.StructType([df.schema[i] for i in kept] + [T.StructField(out, T.BinaryType())])

    def run(batches):
        tokenizer = _tokenizer(raw.value, pattern)
        for batch in batches:
            counts = np.array([n or 0 for n in batch.column(ids).value_lengths().to_pylist()], np.int64)
            part = np.cumsum(counts) // DECODED
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]]).tolist()
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                piece = batch.slice(start, stop - start)
                values = np.asarray(pc.fill_null(piece.column(ids).flatten(), -1)).tolist()
                pieces = map(tokenizer.bytes_of.__getitem__, values)
                decoded = pa.array([b"".join(islice(pieces, n)) for n in counts[start:stop].tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column(i) for i in kept] + [decoded], names=result.names)

    return map_arrow(df, run, result)

"""Substring deduplication with an FM-index for each shard.

Windows of `window` words are routed by content: each goes to the shard of its minimizer, the least
hash of the word runs (seeds) in it, so equal windows always meet. Consecutive windows with one
minimizer travel together as a segment of text, and only where the minimizer may lie in two documents: filters of bounded
size tell. Windows of a minimizer that more than `hot_docs` documents have are dealt further, by a second minimizer
under another hash. A task sends the text of equal segments once, and a shard reads its segments in the order of
their hashes, so copies take no memory there.

A shard indexes its distinct segments: a suffix order of words, its Burrows-Wheeler transform in a
bit-packed wavelet matrix with rank counts, and the smallest document of each class of suffixes that
agree on a whole window. Segments are streamed against it from right to left by backward
search; once a window long, a match is cut back to its class and goes on with the next word, which
gives the matching statistics at one step a word. In the smallest document of a segment, windows whose class has a smaller one are
reported as intervals; in every other document the whole segment is.

Null and empty texts have no words. Rows that share a doc_id are no
smaller than each other; a null doc_id counts as the smallest. Rows equal in id and text get the same result. Long runs of one
minimizer, as in repetitive texts, are cut to segments of SEGMENT windows. An empty table gives an empty one. Other columns are kept; one
with the name of a result, in any case, is replaced. Words are routed by 64-bit hashes and compared as they are within a shard; equal
segments are told by 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import PLAIN, Filter, Words, append, as_bytes, explode, mix, others, quoted, released, schema, stored
from corvane.llm.jaccard_join import NULL_ID

WINDOW, SEED = 50, 8
HOT_DOCS = 2_000
#: Words of segments in one shard, on average; windows of a segment at most; segments that a task remembers to have sent.
SHARD_WORDS, SEGMENT, SENT = 400_000, 1_000, 200_000
SLICE = 1 << 20


def rolling(w: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of n words, from hashes of the words, by doubling."""
    h, have, out, done = mix(w + np.uint64(salt)), 1, None, 0
    left = n
    while left:
        if left & 1:
            out, done = (h, have) if out is None else (mix(out[: len(out) - have] * np.uint64(31) + h[done:]), done + have)
        left >>= 1
        if left:
            h = mix(h[: len(h) - have] * np.uint64(37) + h[have:])
            have *= 2
    return out


def minimizers(w: np.ndarray, window: int, seed: int, salt: int = 0) -> np.ndarray:
    """The least seed hash in each window, mixed again so that all its bits are even."""
    s, span, have = rolling(w, seed, salt), window - seed + 1, 1
    while 2 * have <= span:
        s = np.minimum(s[:-have], s[have:])
        have *= 2
    rest = span - have
    return mix(mix(np.minimum(s[: len(s) - rest], s[rest:]) if rest else s))


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return begin, np.append(begin[1:], len(values))


class Wavelet:
    """Wavelet matrix of a sequence, each level packed in 64-bit words with counts before each."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.n = len(sequence)
        self.levels = []
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = (sequence >> bit) & 1 == 1
            packed = np.packbits(np.pad(ones, (0, 64 - self.n % 64)), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1]
            self.levels.append((np.uint64(bit), packed, before, self.n - int(ones.sum())))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place, for all at once."""
        start = np.zeros_like(at)
        symbol = symbol.astype(np.uint64)
        for bit, packed, before, zeros in self.levels:
            both = np.concatenate([start, at])
            word, inner = both >> 6, (both & 63).astype(np.uint64)
            ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << inner) - np.uint64(1)))
            up = np.tile((symbol >> bit) & np.uint64(1) == 1, 2)
            both = np.where(up, zeros + ones, both - ones)
            start, at = both[: len(at)], both[len(at) :]
        return at - start


class Index:
    """FM-index of segments for patterns of up to window + 1 words; a segment has the smallest document it lies in."""

    def __init__(self, segments: list[list[bytes]], docs: np.ndarray, window: int) -> None:
        self.window = window
        self.codes: dict[bytes, int] = {}
        number = self.codes.setdefault
        lengths = np.array([len(s) + 1 for s in segments], np.int64)
        text = np.zeros(int(lengths.sum()), np.int64)
        at = 0
        for s in segments:
            text[at : at + len(s)] = [number(w, len(self.codes) + 1) for w in s]
            at += len(s) + 1
        self.text, self.begin = text.astype(np.int32), np.concatenate([[0], np.cumsum(lengths)])
        symbols = len(self.codes) + 1
        ranks = {1: text}
        have = 1
        while have <= window:
            pair = ranks[have] * (len(text) + symbols + 1) + np.append(ranks[have][have:], np.zeros(min(have, len(text)), np.int64))[: len(text)]
            order = np.argsort(pair, kind="stable")
            new = np.concatenate([[0], np.cumsum(pair[order][1:] != pair[order][:-1])]) + 1
            have *= 2
            ranks[have] = np.empty_like(text)
            ranks[have][order] = new
        half = have // 2
        ahead = np.append(ranks[half][window - half :], np.zeros(min(window - half, len(text)), np.int64))[: len(text)]
        a, b = ranks[half][order], ahead[order]
        first, stop = runs(a * (len(text) + symbols + 1) + b)
        self.group = np.repeat(np.arange(len(first), dtype=np.int32), stop - first)
        self.first, self.stop = first.astype(np.int32), stop.astype(np.int32)
        self.least = np.minimum.reduceat(np.repeat(docs, lengths)[order], first)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.wavelet = Wavelet(text[order - 1], symbols)

    def least_documents(self, lanes: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of each coded segment (-1: a foreign word), the smallest document that has it; the largest long if none."""
        none = np.iinfo(np.int64).max
        out = [np.full(max(len(x) - self.window + 1, 0), none) for x in lanes]
        live = [k for k, x in enumerate(lanes) if len(x) >= self.window]
        if not live:
            return out
        text = np.concatenate([lanes[k] for k in live])
        base = np.concatenate([[0], np.cumsum([len(lanes[k]) for k in live])])[:-1]
        place = np.array([len(lanes[k]) - 1 for k in live], np.int64)
        where = np.concatenate([[0], np.cumsum([len(out[k]) for k in live])])
        found = np.full(int(where[-1]), none)
        lane, length = np.arange(len(live)), np.zeros(len(live), np.int64)
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(self.text))
        while len(lane):
            symbol = text[base[lane] + place]
            known = np.where(symbol > 0, symbol, 0)
            got = self.wavelet.rank(np.tile(known, 2), np.concatenate([lo, hi])) + np.tile(self.before[known], 2)
            lo, hi = got[: len(lane)], got[len(lane) :]
            dead = (lo >= hi) | (symbol <= 0)
            # a failed match starts again one word to the left of its right end
            place = np.where(dead, place + length - 1, place - 1)
            length = np.where(dead, 0, length + 1)
            lo, hi = np.where(dead, 0, lo), np.where(dead, len(self.text), hi)
            whole = length >= self.window
            group = self.group[lo[whole]]
            found[where[lane[whole]] + place[whole] + 1] = self.least[group]
            lo[whole], hi[whole] = self.first[group], self.stop[group]
            length[whole] = self.window
            on = np.where(length == 0, place >= self.window - 1, place >= 0)
            if not on.all():
                lane, place, length, lo, hi = lane[on], place[on], length[on], lo[on], hi[on]
        for k, a, b in zip(live, where[:-1], where[1:], strict=True):
            out[k] = found[a:b]
        return out


def _merged(flags: np.ndarray, window: int) -> list[int]:
    """Starts and ends, by turns, of the words that the flagged windows cover."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    edge[1::2] += window - 1
    return edge.tolist()


def _search_shard(rows: list[tuple], window: int) -> pa.RecordBatch:
    """h1, h2, doc and spans (in its segment) of the distinct segments of a shard; rows: h1, h2, doc (the smallest), segment."""
    h1, h2, docs, texts = zip(*rows, strict=True)
    index = Index([t.split() for t in texts], np.array(docs, np.int64), window)
    lanes = [index.text[a : b - 1] for a, b in zip(index.begin[:-1], index.begin[1:], strict=True)]
    spans = [_merged(found < doc, window) for found, doc in zip(index.least_documents(lanes), docs, strict=True)]
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (h1, h2, docs)), pa.array(spans, pa.list_(pa.int32()))], names=["h1", "h2", "least", "spans"])


def _search(batches, window: int):
    """Segments (shard, h1, h2, doc, segment) come by shard, hash and document; the first of each hash is indexed."""
    shard, held, last = None, [], None
    for batch in batches:
        for now, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "h1", "h2", "doc", "segment")), strict=True):
            if now != shard and held:
                yield _search_shard(held, window)
                held = []
            if (now, *row[:2]) != last:
                held.append(row)
            shard, last = now, (now, *row[:2])
    if held:
        yield _search_shard(held, window)


def _texts(piece: pa.RecordBatch):
    """Number, word hashes, and word places in raw of each text of a slice; and raw."""
    words = Words(as_bytes(piece.column("text")), PLAIN)
    for i, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)):
        yield i, words.hashes[a:b], words.begin[a:b], words.end[a:b], words.raw


def _minimizer_rows(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """value and doc, once for each distinct minimizer of a document."""

    def make():
        def step(piece):
            values = [np.unique(minimizers(w, window, seed)) if len(w) >= window else np.zeros(0, np.uint64) for _, w, _, _, _ in _texts(piece)]
            take = pa.array(np.repeat(np.arange(len(values)), [len(v) for v in values]))
            return [pa.array(np.concatenate(values).view(np.int64)), piece.column("doc").take(take)]

        return step

    return explode(rows, "text", make, schema("value long, doc long"), SLICE)


def _segments(rows: DataFrame, window: int, seed: int, shards: int, live: Filter, hot: Filter) -> DataFrame:
    """shard, h1, h2, doc, body, start and words of the segments whose minimizer may be live, and the text where the task sends it first."""
    shipped = rows.sparkSession.sparkContext.broadcast((live, hot))  # of bounded size

    def make():
        (live, hot), sent = shipped.value, {}

        def step(piece):
            take, shard, digests, start, size, text = [], [], [], [], [], []
            docs = piece.column("doc").to_pylist()
            for i, w, begin, end, raw in _texts(piece):
                if len(w) < window:
                    continue
                v = minimizers(w, window, seed)
                wanted, often = live(v), hot(v)
                if not wanted.any():
                    continue
                if (often & wanted).any():
                    v = np.where(often, mix(v + minimizers(w, window, seed, 2)), v)
                first, stop = runs(v)
                for a, b in zip(first[wanted[first]].tolist(), stop[wanted[first]].tolist(), strict=True):
                    to = int(v[a] % np.uint64(shards))
                    for at in range(a, b, SEGMENT):
                        last = min(b, at + SEGMENT) - 1 + window
                        h = xxhash.xxh3_128_digest(w[at:last].tobytes())
                        known = sent.get(h)
                        new = known is None or docs[i] < known
                        if new:
                            sent[h] = docs[i]
                        take.append(i)
                        shard.append(to)
                        digests.append(h)
                        start.append(at)
                        size.append(last - at)
                        text.append(raw[begin[at] : end[last - 1]] if new else None)
            if len(sent) > SENT:
                sent.clear()
            if not take:
                return None
            at = pa.array(take, pa.int32())
            h = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
            return [pa.array(shard, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), piece.column("doc").take(at), piece.column("body").take(at), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(text, pa.binary())]

        return step

    return explode(rows, "text", make, schema("shard int, h1 long, h2 long, doc long, body long, start int, words int, segment binary"), SLICE)


def repeated_spans(rows: DataFrame, window: int = WINDOW, seed: int = SEED, hot_docs: int = HOT_DOCS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc, body and spans (starts and ends of word intervals by turns, in any order) covered by windows that a smaller document has; rows: doc, body, text."""
    found = _minimizer_rows(rows, window, seed)
    values = found.groupBy("value").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most")
    live = stored(values.select(F.col("value").alias("key"), "n"))
    total = live.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total * 3 * window // 2 // shard_words))
    segments = stored(_segments(rows, window, seed, shards, Filter(live), Filter(live.where(F.col("n") > hot_docs))))
    texts = segments.where("segment is not null").select("shard", "h1", "h2", "doc", "segment")
    dealt = texts.repartition("shard").sortWithinPartitions("shard", "h1", "h2", "doc")
    least = stored(dealt.mapInArrow(released(lambda b: _search(b, window)), schema("h1 long, h2 long, least long, spans array<int>")))
    met = segments.select("h1", "h2", "doc", "body", "start", "words").join(least, ["h1", "h2"])
    whole = F.array(F.col("start"), F.col("start") + F.col("words"))
    spans = F.when(F.col("doc") > F.col("least"), whole).otherwise(F.transform("spans", lambda x: x + F.col("start")))
    return met.select("doc", "body", spans.alias("spans")).where(F.size("spans") > 0).groupBy("doc", "body").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with n_words, removed_spans (starts and ends of word intervals by turns) and kept_text, the words left joined by one space."""
    kept = others(docs, "n_words", "removed_spans", "kept_text")
    keyed = docs.select(*kept, F.coalesce(F.col(quoted(doc_id)).cast("long"), F.lit(NULL_ID)).alias("__doc"), F.xxhash64(quoted(text)).alias("__body"), F.col(quoted(text)).alias("__text"))
    spans = repeated_spans(keyed.select(F.col("__doc").alias("doc"), F.col("__body").alias("body"), F.col("__text").alias("text")), **options)
    joined = keyed.join(spans.select(F.col("doc").alias("__doc"), F.col("body").alias("__body"), F.col("spans").alias("__spans")), ["__doc", "__body"], "left")

    def make():
        def step(piece):
            counts, gone, left_text = [], [], []
            for t, spans in zip(as_bytes(piece.column("__text")), piece.column("__spans").to_pylist(), strict=True):
                tokens = t.split() if t else []
                counts.append(len(tokens))
                merged: list[list[int]] = []
                for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)) if spans else ():
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                left, at = [], 0
                for a, b in merged:
                    left += tokens[at:a]
                    at = b
                left_text.append(b" ".join(left + tokens[at:]))
                gone.append([x for pair in merged for x in pair])
            return [pa.array(counts, pa.int64()), pa.array(gone, pa.list_(pa.int64())), pa.array(left_text, pa.binary()).cast(pa.string())]

        return step

    fields = [T.StructField("n_words", T.LongType()), T.StructField("removed_spans", T.ArrayType(T.LongType())), T.StructField("kept_text", T.StringType())]
    return append(joined, "__text", make, fields).drop("__doc", "__body", "__spans", "__text")

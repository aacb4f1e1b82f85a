"""Line deduplication over a corpus, by compressed keep bitmaps.

Line keys are hashed to 128 bits. First occurrences per document are range-partitioned by hash with a
secondary sort by document and position and streamed once: a run of equal hashes is counted in
constant memory. Of every BATCH rows of a partition at most min_docs documents of a key are sent (enough to decide), so a
line that all documents share stays small. Its occurrences meet its key in a join whose large partitions Spark splits when it runs. The lines of dropped keys come back as one compressed
keep bitmap per document; texts meet only their bitmap.

mode "all" drops every line of a key found in at least min_docs documents; mode "first" keeps the
line at the smallest document and position. A document is a (doc_id, text) pair: rows equal in both
count once and get the same result. Null doc_id is one id of its own; null text is an empty line.
Lines whose key is shorter than min_chars never go. Very long texts are cut into lines whole, one at a time. An empty table gives an empty one.
Other columns stay; names that begin with two underscores are kept for columns of this module, and one with the name of a result is replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import BLANKS, append, as_bytes, explode, schema, stored

#: Rows in which the stage before the shuffle looks for repeated keys.
BATCH = 200_000


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Hash, document and position of every line that may go."""

    def make():
        digest = xxhash.xxh3_128_digest

        def step(piece):
            rows, at, digests, counts = [], [], [], []
            for i, t in enumerate(as_bytes(piece.column("text"))):
                keys = [line_key(line) for line in (t or b"").split(b"\n")]
                kept = [k for k, key in enumerate(keys) if key and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)]
                rows += [i] * len(kept)
                at += kept
                counts += [len(keys)] * len(kept)
                digests += [digest(keys[k]) for k in kept]
            if not rows:
                return None
            h = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
            take = pa.array(rows, pa.int32())
            return [pa.array(h[:, 0]), pa.array(h[:, 1]), piece.column("doc").take(take), piece.column("body").take(take), pa.array(at, pa.int32()), pa.array(counts, pa.int32())]

        return step

    return explode(docs, "text", make, schema("h1 long, h2 long, doc long, body long, line int, n_lines int"))


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    """h1, h2, doc (null as the smallest long), line."""
    doc = batch.column("doc").fill_null(np.iinfo(np.int64).min)
    return [np.asarray(batch.column("h1")), np.asarray(batch.column("h2")), np.asarray(doc), np.asarray(batch.column("line"))]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def _first_lines(batches, min_docs: int):
    """Of each batch, a key's first line in each of its min_docs smallest documents at most."""
    for whole in batches:
        for cut in range(0, whole.num_rows, BATCH):
            batch = whole.slice(cut, BATCH)
            h1, h2, doc, line = _columns(batch)
            order = np.lexsort((line, doc, h2, h1))
            h1, h2, doc, line = h1[order], h2[order], doc[order], line[order]
            first = _starts(h1, h2, doc)
            h1, h2, doc, line = h1[first], h2[first], doc[first], line[first]
            begin = np.flatnonzero(_starts(h1, h2))
            nth = np.arange(len(h1)) - np.repeat(begin, np.diff([*begin, len(h1)]))
            few = nth < min_docs
            yield pa.RecordBatch.from_arrays([pa.array(c[few]) for c in (h1, h2, doc, line)], names=["h1", "h2", "doc", "line"])


def _stream(batches, min_docs: int):
    """Keys in at least min_docs documents, with their first document and line, from rows sorted by key, document and line."""
    key = first = last = None
    docs = 0

    def found(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["h1", "h2", "first_doc", "first_line"])

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, line = _columns(batch)
        begin = np.flatnonzero(_starts(h1, h2))
        per = np.add.reduceat(_starts(h1, h2, doc).astype(np.int64), begin)
        stop = np.append(begin[1:], len(h1))
        out = []
        if key == (h1[0], h2[0]):
            docs += int(per[0]) - (doc[0] == last)
        else:
            if docs >= min_docs:
                out.append((*key, *first))
            key, first, docs = (h1[0], h2[0]), (doc[0], line[0]), int(per[0])
        if len(begin) > 1:
            if docs >= min_docs:
                out.append((*key, *first))
            for k in np.flatnonzero(per[1:-1] >= min_docs) + 1:
                out.append((h1[begin[k]], h2[begin[k]], doc[begin[k]], line[begin[k]]))
            b = begin[-1]
            key, first, docs = (h1[b], h2[b]), (doc[b], line[b]), int(per[-1])
        last = doc[stop[-1] - 1]
        if out:
            yield found(out)
    if docs >= min_docs:
        yield found([(*key, *first)])


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, mode: str = "all") -> DataFrame:
    """doc, body (hash of the text) and keep (zlib of one bit a line, 1: stays) of each document that loses a line."""
    if mode not in ("all", "first") or min_docs < 1:
        raise ValueError("mode is 'all' or 'first', min_docs at least 1")
    lines = stored(_lines(_keyed(docs, doc_id, text), min_chars))
    some = lines.select("h1", "h2", "doc", "line").mapInArrow(lambda b: _first_lines(b, max(min_docs, 1)), schema("h1 long, h2 long, doc long, line int"))
    ranged = some.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "doc", "line")
    common = ranged.mapInArrow(lambda b: _stream(b, min_docs), schema("h1 long, h2 long, first_doc long, first_line int"))
    gone = lines.join(common, ["h1", "h2"])
    if mode == "first":
        gone = gone.where(~((F.coalesce("doc", F.lit(-(2**63))) == F.col("first_doc")) & (F.col("line") == F.col("first_line"))))
    per_doc = gone.groupBy("doc", "body").agg(F.collect_set("line").alias("lines"), F.max("n_lines").alias("n_lines"))

    def pack(batches):
        for batch in batches:
            keeps = []
            for gone_lines, n in zip(batch.column("lines").to_pylist(), batch.column("n_lines").to_pylist(), strict=True):
                bits = np.ones(n, np.uint8)
                bits[gone_lines] = 0
                keeps.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("body"), pa.array(keeps, pa.binary())], names=["doc", "body", "keep"])

    return per_doc.mapInArrow(pack, schema("doc long, body long, keep binary"))


def drop_lines(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with kept_text, n_lines (before) and n_dropped; a text that keeps no line becomes empty."""
    left = docs.withColumns({"__doc": F.col(doc_id).cast("long"), "__body": F.xxhash64(text)})
    joined = left.join(bitmaps.select(F.col("doc").alias("__d"), F.col("body").alias("__b"), F.col("keep").alias("__keep")), F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__body") == F.col("__b")), "left")

    def make():
        def step(piece):
            texts, lines, dropped = [], [], []
            for t, keep in zip(as_bytes(piece.column(text)), piece.column("__keep").to_pylist(), strict=True):
                parts = (t or b"").split(b"\n")
                lines.append(len(parts))
                if keep:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(parts)).tolist()
                    parts = [p for p, bit in zip(parts, bits, strict=True) if bit]
                dropped.append(lines[-1] - len(parts))
                texts.append(b"\n".join(parts))
            return [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]

        return step

    fields = [T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    return append(joined, text, make, fields).drop("__doc", "__body", "__d", "__b", "__keep")

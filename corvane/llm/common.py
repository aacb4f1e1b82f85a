"""What the text operators share: input tables, shared scratch folders, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text handled at once by a Python worker, in bytes; a longer text is handled alone.
SLICE_BYTES = 4 << 20
#: All bytes of the class [\x20\x09-\x0D]; bytes.split() and this strip agree on it.
BLANKS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo modulus; a null counts as empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a local one only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext.getCheckpointDir()
        if not found and not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = found or "file://" + tempfile.mkdtemp(prefix="corvane-")
        if not found:
            spark.sparkContext.setCheckpointDir(base)
            _drop_at_exit(spark, base)
    return base.rstrip("/")


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    """Let the file system delete path when the application ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/corvane-{name}-{uuid.uuid4().hex}"
    _drop_at_exit(spark, path)
    return path


def _trim() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def _trim_jvm(spark: SparkSession) -> str | None:
    """Let the driver's JVM give freed native memory back to the system, and return what it says; None if it can't.

    Each thread that compiles or plans leaves some with the C library, which keeps it: hundreds of MB after some hundred queries.
    """
    jvm = spark._jvm
    try:
        beans = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods()
        invoke = next(m for m in beans if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # a JVM or C library without this command
        return None


def settle(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and broadcasts of finished queries, and the driver its garbage and freed memory."""
    _trim()
    spark._jvm.System.gc()
    _trim_jvm(spark)


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there and nothing is computed twice."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    settle(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete what stored() has written for tables that nothing reads any more, and the shuffle files of finished queries."""
    for df in tables:
        for path in {os.path.dirname(f) for f in df.inputFiles()}:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
    if tables:
        settle(tables[0].sparkSession)


class Filter:
    """Tells most 64-bit keys that are not in a table of keys (a long column, key); never denies one that is. Its size is bounded."""

    #: Bits at most, and of the pieces that it is put together from, as powers of 2.
    BITS, PIECE_BITS = 28, 16

    def __init__(self, keys: DataFrame) -> None:
        self.bits = bits = min(self.BITS, max(self.PIECE_BITS, (16 * keys.count()).bit_length()))
        piece_bits, size = self.PIECE_BITS, 1 << self.PIECE_BITS

        def run(batches):
            pieces = {}
            for batch in batches:
                slot = np.asarray(batch.column("slot"))
                order = np.argsort(slot)
                slot = slot[order]
                at, first = np.unique(slot // size, return_index=True)
                for piece, part in zip(at.tolist(), np.split(slot % size, first[1:]), strict=True):
                    pieces.setdefault(piece, np.zeros(size, bool))[part] = True
            if pieces:
                packed = [np.packbits(x, bitorder="little").tobytes() for x in pieces.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int64()), pa.array(packed, pa.binary())], names=["piece", "bitmap"])

        slots = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("slot"))
        dealt = slots.repartition(F.shiftrightunsigned("slot", piece_bits))
        self.bitmap = np.zeros(1 << (bits - 3), np.uint8)
        for row in dealt.mapInArrow(run, schema("piece long, bitmap binary")).toArrow().to_batches():
            for piece, bitmap in zip(row.column("piece").to_pylist(), row.column("bitmap"), strict=True):
                self.bitmap[piece * size // 8 : (piece + 1) * size // 8] = np.frombuffer(bitmap.as_buffer(), np.uint8)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = keys >> np.uint64(64 - self.bits)
        return (self.bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about limit bytes of the text column at most."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(start, stop - start)


#: Byte tables: ASCII letters lower-cased, white space as one sign; and white space alone.
LOWER = bytes(32 if b in BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256))
PLAIN = bytes(32 if b in BLANKS else b for b in range(256))
#: Bytes hashed at once; words of more bytes than LONG_WORD are hashed one by one.
HASHED_BYTES, LONG_WORD = 1 << 20, 64
_BYTE = np.random.default_rng(64).integers(-(2**63), 2**63, 256, dtype=np.int64).view(np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)])) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_BASE)
    return h ^ (h >> np.uint64(29))


class Words:
    """Words of some texts in a row: a 64-bit hash of each, where it begins and ends in raw (the texts by the table, a blank between them), and the bounds of the texts.

    table says what each byte counts as; a word is a run of what is not the blank.
    """

    def __init__(self, texts: list[bytes | None], table: bytes = LOWER) -> None:
        self.raw = raw = b" ".join([*(t or b"" for t in texts), b""]).translate(table)
        parts, at = [], 0
        while at < len(raw):
            stop = len(raw)
            if stop - at > 2 * HASHED_BYTES:
                stop = raw.rfind(b" ", at, at + HASHED_BYTES) + 1 or raw.find(b" ", at + HASHED_BYTES) + 1
            parts.append(self._part(at, stop))
            at = stop
        self.hashes, self.begin, self.end = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        offsets = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
        self.bounds = np.searchsorted(self.begin, offsets)

    def _part(self, at: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of raw from one place to another; a blank ends it."""
        signs = np.frombuffer(self.raw, np.uint8, stop - at, at)
        edge = np.diff(np.concatenate([[0], (signs != 32).view(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if stop - at > 2 * HASHED_BYTES:  # one word of this size and its blank
            hashes = np.zeros(len(begin), np.uint64)
        else:
            power, inverse = _powers(2 * HASHED_BYTES + 1)
            sums = np.zeros(len(signs) + 1, np.uint64)
            np.cumsum(_BYTE[signs] * power[: len(signs)], out=sums[1:])
            hashes = mix(mix((sums[end] - sums[begin]) * inverse[begin]))
        for k in np.flatnonzero(end - begin > LONG_WORD):
            hashes[k] = xxhash.xxh3_64_intdigest(self.raw[at + begin[k] : at + end[k]])
        return hashes, begin + at, end + at


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """df.mapInArrow for columns of any name, dots included; the worker's memory is given back at the end."""
    names = df.columns

    def named(batches):
        return run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(released(named), schema)


def quoted(name: str) -> str:
    """A column's name as Spark resolves it literally, dots included."""
    return "`" + name.replace("`", "``") + "`"


def others(df: DataFrame, *names: str) -> list[str]:
    """Columns of df, quoted, without those that have one of the names, whatever their case."""
    taken = {n.lower() for n in names}
    return [quoted(c) for c in df.columns if c.lower() not in taken]


def released(run: Callable) -> Callable:
    """run, which gives freed memory back to the system at its end, so that an idle worker holds little."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _trim()

    return wrapped


def append(df: DataFrame, text: str, make: Callable[[], Callable], fields: list[T.StructField], limit: int = SLICE_BYTES) -> DataFrame:
    """df and the columns that make()(piece) returns for each piece of a batch, of about limit bytes of text each.

    A column of df that has the name of a new one, whatever its case, is replaced.
    """
    names = {f.name.lower() for f in fields}
    kept = [i for i, f in enumerate(df.schema) if f.name.lower() not in names]
    schema = T.StructType([df.schema[i] for i in kept] + fields)
    out = schema.names

    def run(batches):
        step = make()
        for batch in batches:
            for piece in slices(batch, text, limit):
                yield pa.RecordBatch.from_arrays([piece.column(i) for i in kept] + step(piece), names=out)
        getattr(step, "close", int)()

    return map_arrow(df, run, schema)


def explode(df: DataFrame, text: str, make: Callable[[], Callable], schema: T.StructType, limit: int = SLICE_BYTES) -> DataFrame:
    """Rows that make()(piece) returns, as a list of arrays or None, for each piece of a batch."""
    names = schema.names

    def run(batches):
        step = make()
        for batch in batches:
            for piece in slices(batch, text, limit):
                if (arrays := step(piece)) is not None:
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    return map_arrow(df, run, schema)


def schema(spec: str) -> T.StructType:
    """A schema from 'name type, ...'."""
    return T.StructType.fromDDL(spec)

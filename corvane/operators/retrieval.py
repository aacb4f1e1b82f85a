"""Exact vector search, keyword overlap and their blend, for batches of questions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as D

from corvane.functions import text as T
from corvane.sources.scratch import stored

BUCKETS = 64
#: Questions that one pass over the chunks answers; their vectors go to the executors, 16 bytes for each of the 64 counts and 4 kB of candidates.
QUESTION_BLOCK = 16_384
#: Questions and chunks that meet in one matrix product, and bytes of text that are embedded at once.
QUESTION_TILE, CHUNK_TILE, TEXT_BYTES = 512, 2_048, 4 << 20


class _Buckets(dict):
    """Buckets of words by the last digits of their MD5, remembered up to a limit."""

    LIMIT = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = b = hashlib.md5(word.encode()).digest()[-1] % BUCKETS
        return b


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about TEXT_BYTES of a column; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // TEXT_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    return (batch.slice(start, stop - start) for start, stop in zip(cuts[:-1], cuts[1:], strict=True) if stop > start)


class HashedWords:
    """The default embedder: counts of the lower-cased words of a text by hash bucket; a text without words has zeros."""

    def __init__(self) -> None:
        self.buckets, self.words = _Buckets(), re.compile("[a-z]+")

    def __call__(self, texts: list[str]) -> np.ndarray:
        """An integer matrix with a row for each text."""
        out = np.zeros((len(texts), BUCKETS), np.int64)
        for i, t in enumerate(texts):
            found = self.words.findall(t.lower())
            out[i] = np.bincount(np.fromiter(map(self.buckets.__getitem__, found), np.int64, len(found)), minlength=BUCKETS)
        return out


def embed(df: DataFrame, embedder: Callable[[], Callable[[list[str]], np.ndarray]] = HashedWords) -> DataFrame:
    """df with v and norm2, the vector of text (null: empty) as whole numbers and its squared length.

    embedder() makes the model, once in each task; it gets lists of texts and returns a row of BUCKETS whole numbers for each (a model with
    fractions scales them). A pass over Arrow batches without a shuffle, since a row needs no other.
    """
    kept = [i for i, c in enumerate(df.columns) if c not in ("v", "norm2")]
    out = D.StructType([df.schema[i] for i in kept] + [D.StructField("v", D.ArrayType(D.LongType())), D.StructField("norm2", D.LongType())])

    def run(batches):
        model = None
        for batch in batches:
            for piece in _pieces(batch, "text"):
                model = model or embedder()
                v = np.asarray(model([t or "" for t in piece.column("text").to_pylist()]), np.int64)
                vectors = pa.ListArray.from_arrays(np.arange(0, v.size + 1, BUCKETS, dtype=np.int32), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column(i) for i in kept] + [vectors, pa.array((v * v).sum(axis=1))], names=out.names)

    return df.mapInArrow(run, out)


def cosine(dot, a, b):
    return F.when(a * b > 0, dot.cast("double") / F.sqrt((a * b).cast("double"))).otherwise(F.lit(0.0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, BUCKETS)


class _Best:
    """The best chunks of each question so far: similarity, source, chunk; worst says what a further one must reach."""

    def __init__(self, questions: int, pool: int) -> None:
        self.pool, self.found, self.worst = pool, [[] for _ in range(questions)], np.full(questions, -np.inf)

    def add(self, start: int, sims: np.ndarray, places: list[tuple]) -> None:
        """sims: a row for each question from start on, a column for each of places."""
        hope = (sims >= self.worst[start : start + len(sims), None]).any(axis=1)
        for k in np.flatnonzero(hope).tolist():
            sim, found = sims[k], self.found[start + k]
            least = self.worst[start + k]
            if len(sim) > self.pool:
                least = max(least, np.partition(sim, len(sim) - self.pool)[len(sim) - self.pool])
            at = np.flatnonzero(sim >= least)
            found += [(-x, places[i]) for x, i in zip(sim[at].tolist(), at.tolist(), strict=True)]
            found.sort()
            del found[self.pool :]
            if len(found) == self.pool:
                self.worst[start + k] = -found[-1][0]


def _best_of(chunks: DataFrame, block: pa.Table, pool: int) -> DataFrame:
    """The best chunks of each task for each question of a block."""
    ids = block["qid"].to_pylist()
    shipped = chunks.sparkSession.sparkContext.broadcast((_matrix(block["v"].combine_chunks()), block["norm2"].to_numpy().astype(np.float64)))  # QUESTION_BLOCK rows at most

    def run(batches):
        best = None
        for batch in batches:
            q, qn = shipped.value
            best = best or _Best(len(q), pool)
            for at in range(0, batch.num_rows, CHUNK_TILE):
                piece = batch.slice(at, CHUNK_TILE)
                c, cn = _matrix(piece.column("v")), np.asarray(piece.column("norm2"), np.float64)
                # a null source comes first, as in Spark's order
                places = [(s is not None, (s or "").encode(), i is not None, i or 0) for s, i in zip(piece.column("source_id").to_pylist(), piece.column("chunk_index").to_pylist(), strict=True)]
                for start in range(0, len(q), QUESTION_TILE):
                    some = slice(start, start + QUESTION_TILE)
                    sims = q[some] @ c.T  # sums of integers: exact
                    norms = qn[some, None] * cn[None, :]
                    np.sqrt(norms, out=norms)
                    np.divide(sims, norms, out=sims, where=norms > 0)
                    best.add(start, sims, places)
        if best is not None:
            for start in range(0, len(ids), QUESTION_TILE):
                rows = [(q, s.decode() if named else None, i if numbered else None, -x) for q, found in zip(ids[start : start + QUESTION_TILE], best.found[start : start + QUESTION_TILE], strict=True) for x, (named, s, numbered, i) in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.float64()), strict=True)], names=["qid", "source_id", "chunk_index", "sim"])

    return chunks.select("source_id", "chunk_index", "v", "norm2").mapInArrow(run, _FOUND)


_FOUND = "qid long, source_id string, chunk_index long, sim double"


def vector_top(questions: DataFrame, chunks: DataFrame, pool: int = 20) -> DataFrame:
    """qid, source_id, chunk_index, sim and rank: the chunks of the highest cosine (ties: smaller key) of each question.

    questions (qid a long) and chunks are embedded and stored. A block of questions goes to the executors; each task goes through its chunks once,
    tile by tile, and returns its best only, so what is shuffled grows with questions and tasks and not with the pairs. Questions beyond a block are
    further passes. A null qid is a question like others, a null source or number comes before others; no questions give no rows.
    """
    q = questions.select(F.col("qid").cast("long").alias("qid"), "v", "norm2")
    found, blocks = None, -(-q.count() // QUESTION_BLOCK)
    for k in range(blocks):
        block = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k)).toArrow()
        one = _best_of(chunks, block, pool)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = questions.sparkSession.createDataFrame([], _FOUND)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "source_id", "chunk_index"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= pool)


def overlap(pool: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """pool with kw: the share of the question's keywords that the chunk has, repeats counted; 0 without keywords.

    pool is stored first: as Spark knows how small it is, chunks are not shuffled to find its texts.
    """
    pool = stored(pool)
    wanted = questions.select("qid", F.explode(T.keywords("question")).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qc"))
    total = wanted.groupBy("qid").agg(F.sum("qc").alias("total"))
    keys = pool.select("source_id", "chunk_index").distinct()
    had = chunks.join(keys, ["source_id", "chunk_index"]).select("source_id", "chunk_index", F.explode(T.keywords("text")).alias("term")).groupBy("source_id", "chunk_index", "term").agg(F.count(F.lit(1)).alias("cc"))
    common = pool.select("qid", "source_id", "chunk_index").join(wanted, "qid").join(had, ["source_id", "chunk_index", "term"]).groupBy("qid", "source_id", "chunk_index").agg(F.sum(F.least("qc", "cc")).alias("common"))
    joined = pool.join(common, ["qid", "source_id", "chunk_index"], "left").join(total, "qid", "left")
    return joined.withColumn("kw", F.coalesce(F.coalesce("common", F.lit(0)).cast("double") / F.col("total").cast("double"), F.lit(0.0))).drop("common", "total")


def blend(pool: DataFrame, weight) -> DataFrame:
    """pool with score, the blend of sim and kw; weight is a column or a number."""
    w = weight if not isinstance(weight, (int, float)) else F.lit(float(weight))
    return pool.withColumn("score", (F.lit(1.0) - w) * F.col("sim") + w * F.when(w > 0, F.col("kw")).otherwise(F.lit(0.0)))


def ranked(scored: DataFrame, top: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "source_id", "chunk_index"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).withColumn("score", F.round("score", 4))


def hybrid(pool: DataFrame, weight: float, top: int = 5) -> DataFrame:
    return ranked(blend(pool, weight), top).select("qid", "rank", "source_id", "chunk_index", "score")

"""Exact top-k inner products by MaxScore.

Dimensions are the query's terms and a shard's column is a term's posting list. From the bounds of
each column a query's terms are split: the essential ones, largest spread first, are traversed for
all rows of the shard; the rest, whose bounds together cannot reach the threshold alone, are probed
a few at a time and only for rows that still can compete. Shard results are merged by rank.

Rows are dealt to shards once. A block of queries, of bounded size, goes to all tasks; each reads its shards one after the other and keeps the
best of each query so far, whose last score is where the next shard's threshold starts. So what is shuffled grows with the rows, and with queries times tasks, never with
pairs or with rows times blocks; further blocks are further passes over the shards. Components become floor(scale * x). Vectors that are null or hold a null or
non-finite component, and rows with a null id, take no part; shorter vectors count as padded with 0.
An empty table gives no rows. A query never meets rows of its own id; query rows that share an id count once (the smallest
vector); candidate rows that share one are ranked each. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import released, schema, stored

#: Rows of a shard, bytes of a block of queries (8 for a component), dimensions probed at once.
SHARD_ROWS, BLOCK_BYTES, PROBE = 8_192, 8 << 20, 4
#: Sums below this are exact in doubles; larger ones are computed in 64-bit integers.
_EXACT = float(1 << 53)


def integer_vectors(df: DataFrame, vector: str, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), inner] = values.flatten().to_numpy(zero_copy_only=False)
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def max_score(query: np.ndarray, own: int, postings: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, threshold: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows of a shard that reach the threshold; postings has a row for each dimension."""
    upper, lower = np.maximum(query * high, query * low), np.minimum(query * high, query * low)
    order = np.argsort(lower - upper, kind="stable")
    rest = np.append(np.cumsum(upper[order][::-1])[::-1], 0)
    least = np.append(np.cumsum(lower[order][::-1])[::-1], 0)
    rows = np.flatnonzero(ids != own)
    if len(rows) > 8 * k:
        seeds = rows[:: max(1, len(rows) // (8 * k))]
        s = query @ postings[:, seeds]
        threshold = max(threshold, np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else threshold
    essential = int(np.argmax(rest < threshold)) if (rest < threshold).any() else len(order)
    scores = query[order[:essential]] @ postings[order[:essential]]
    scores = scores[rows]
    done = essential
    while done < len(order):
        still = scores + rest[done] >= threshold
        rows, scores = rows[still], scores[still]
        step = order[done : done + PROBE]
        scores = scores + query[step] @ postings[np.ix_(step, rows)]
        done += PROBE
        if len(scores) >= k:
            threshold = max(threshold, np.partition(scores, len(scores) - k)[len(scores) - k] + least[min(done, len(order))])
    top = best(scores, ids[rows], k)
    return ids[rows][top], scores[top]


class Ranking:
    """The k best rows of each query so far."""

    NONE = np.iinfo(np.int64).min

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.own, self.vectors, self.k = ids, vectors, k
        self.ids, self.scores = np.full((len(ids), k), np.iinfo(np.int64).max), np.full((len(ids), k), self.NONE)

    def search(self, ids: np.ndarray, v: np.ndarray) -> None:
        """Add the rows of a shard."""
        width = max(v.shape[1], self.vectors.shape[1])
        q, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (self.vectors, v))
        most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(v.astype(float)).max(initial=0)) * max(width, 1)
        if most < _EXACT:
            q, v = q.astype(np.float64), v.astype(np.float64)
        postings, low, high = np.ascontiguousarray(v.T), v.min(axis=0), v.max(axis=0)
        found, scores = np.full(self.ids.shape, np.iinfo(np.int64).max), np.full(self.ids.shape, self.NONE)
        for i, (own, query, last) in enumerate(zip(self.own, q, self.scores[:, -1], strict=True)):
            some, reached = max_score(query, own, postings, ids, low, high, self.k, -np.inf if last == self.NONE else last)
            found[i, : len(some)], scores[i, : len(some)] = some, reached
        both, every = np.concatenate([self.scores, scores], axis=1), np.concatenate([self.ids, found], axis=1)
        order = np.lexsort((every, np.where(both == self.NONE, np.iinfo(np.int64).max, -both)), axis=1)[:, : self.k]
        self.scores, self.ids = np.take_along_axis(both, order, 1), np.take_along_axis(every, order, 1)

    def table(self) -> pa.RecordBatch:
        query, place = np.nonzero(self.scores != self.NONE)
        return pa.RecordBatch.from_arrays([pa.array(self.own[query]), pa.array(self.ids[query, place]), pa.array(self.scores[query, place])], names=["query_id", "vec_id", "score"])


def _in_shards(batches):
    """Tables of about SHARD_ROWS rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= SHARD_ROWS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _search(rows: DataFrame, block: pa.Table, k: int) -> DataFrame:
    width = int(np.max(block["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False), initial=0))
    shipped = rows.sparkSession.sparkContext.broadcast((block["id"].to_numpy(), _matrix(block["v"], width)))  # BLOCK_BYTES at most

    def run(batches):
        ranking = None
        for shard in _in_shards(batches):
            ranking = ranking or Ranking(*shipped.value, k)
            wide = int(np.max(shard["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False), initial=0))
            ranking.search(shard["id"].to_numpy(), _matrix(shard["v"], wide))
        if ranking is not None:
            yield ranking.table()

    return rows.mapInArrow(released(run), schema("query_id long, vec_id long, score long"))


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10, scale: int = 1024, id_column: str = "vec_id", vector: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows."""

    def usable(df):
        ok = F.col(id_column).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(ok).select(F.col(id_column).cast("long").alias("id"), integer_vectors(df, vector, scale).alias("v"))

    q = stored(usable(queries).groupBy("id").agg(F.min("v").alias("v")))
    count, width = q.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    v = usable(rows)
    shards = max(1, -(-v.count() // SHARD_ROWS))
    v = v.repartition(shards)
    blocks = -(-count // max(1, block_bytes // (8 * max(width or 1, 1))))
    if blocks > 1:
        v = stored(v)
    found = None
    for b in range(blocks):
        one = _search(v, (q if blocks == 1 else q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).toArrow(), k)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = q.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Streaming ingestion of documents into the chunk index.

The index is the state: every chunk carries the MD5 of its document's text and the version that the text came with. A batch is reduced to the newest row of each document;
what has the text that the index has is skipped, what is older than it too, the rest replaces its document, and a deletion takes it out. So a batch that is
run again, or a document that is sent again, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators import retrieval
from corvane.operators.chunking import chunks
from corvane.sources.index import Index
from corvane.sources.scratch import stored

CHUNKS = "source_id string, chunk_index long, text string, doc_hash string, doc_version long, v array<long>, norm2 long"


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(spark, path).create(spark.createDataFrame([], CHUNKS).schema)


def apply(batch: DataFrame, index: Index, size: int = 800, overlap: int = 120) -> dict[str, int]:
    """Bring documents (doc_id, text, and perhaps version and deleted) into the index; how many were replaced, deleted and skipped.

    Of rows with one doc_id the one of the highest version counts (null: lowest), then of the largest hash. A null doc_id is a document. A deleted document is forgotten with its version.
    """
    version = F.col("version").cast("long") if "version" in batch.columns else F.lit(None).cast("long")
    deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in batch.columns else F.lit(False)
    rows = batch.select(F.col("doc_id").cast("string").alias("source_id"), F.coalesce("text", F.lit("")).alias("text"), version.alias("version"), deleted.alias("deleted"))
    rows = rows.withColumn("hash", F.md5("text"))
    newest = stored(rows.groupBy("source_id").agg(F.max_by(F.struct("text", "hash", "version", "deleted"), F.struct(F.coalesce("version", F.lit(-(2**63))), "hash")).alias("d")).select("source_id", "d.*"))
    known = index.of_sources(newest).groupBy("source_id").agg(F.max("doc_hash").alias("old_hash"), F.max("doc_version").alias("old_version")).withColumnRenamed("source_id", "known")
    met = newest.join(known, F.col("source_id").eqNullSafe(F.col("known")), "left").withColumn("there", F.col("old_hash").isNotNull())
    late = F.coalesce(F.col("version") < F.col("old_version"), F.lit(False))
    change = F.when(late, F.lit(False)).when(F.col("deleted"), F.col("there")).otherwise(~F.col("hash").eqNullSafe(F.col("old_hash")) & (F.col("there") | F.col("text").rlike(r"\S")))
    changed = stored(met.where(change).select("source_id", "text", "hash", "version", "deleted"))
    counted = changed.agg(F.count_if("deleted"), F.count_if(~F.col("deleted"))).first()
    if counted[0] + counted[1]:
        written = changed.where(~F.col("deleted"))
        told = written.select(F.col("source_id").alias("s"), F.col("hash").alias("doc_hash"), F.col("version").alias("doc_version"))
        new = chunks(written, size, overlap).join(told, F.col("source_id").eqNullSafe(F.col("s"))).drop("s")
        index.upsert(retrieval.embed(new), changed.select("source_id"))
    return {"replaced": counted[1], "deleted": counted[0], "skipped": newest.count() - counted[0] - counted[1]}


def ingest(spark: SparkSession, source: str, schema: str, index: str, checkpoint: str, size: int = 800, overlap: int = 120) -> StreamingQuery:
    """Bring new files of source into the index at a path, until none is left."""
    target = open_index(spark, index)

    def write(batch: DataFrame, _: int) -> None:
        apply(batch, target, size, overlap)

    return spark.readStream.schema(schema).parquet(source).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()

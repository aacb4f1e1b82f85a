"""The chunk index: embedded chunks with their paper's fields, in hash buckets of their source.

An index is a folder. `data/<write>/bucket=<k>` holds what one write has put into one bucket, sorted by source and chunk, so that a file's minima and
maxima tell most sources apart. New chunks are written in this form first; if their buckets were empty, that is all. `manifests/<version>.json` names the folder of each bucket. A version is never changed: a write reads the buckets that its
documents fall into, leaves the chunks of these documents out, adds the new ones, writes these buckets anew, and then gives its manifest the next number by a
rename that fails if the number is taken. So a reader sees a whole version, a write that fails leaves nothing behind that counts, and of two
writers one starts again from the other's version. What a write costs grows with the buckets that it touches, not with the index.

A document is replaced whole: chunks that a shorter text no longer has are gone, and so is a document without any. Null sources are one document.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.sources.scratch import dropped, settle, stored
from corvane.sources.versions import Conflict, Versions

BUCKETS = 64
#: Versions that stay readable for queries that began before the newest one.
KEEP = 2
#: How often a writer starts again after another one was faster.
ATTEMPTS = 20
#: Parts of a bucket that a first write deals to tasks.
SLOTS = 4


def bucket_of(source: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(buckets)).cast("int")


class Index(Versions):
    """The index at a path; `create` makes an empty one, if there is none."""

    def create(self, schema: T.StructType, buckets: int = BUCKETS) -> Index:
        """An empty index for chunks of a schema (source_id, chunk_index and others), if there is none."""
        if not self.versions():
            try:
                self._publish(1, {"buckets": buckets, "schema": json.loads(schema.json()), "folders": {}})
            except Conflict:  # another one has made it
                pass
        return self

    # --- reading ---

    def read(self, version: int | None = None) -> DataFrame:
        """All chunks of a version, and their bucket."""
        return self._rows(self.manifest(version))

    def _rows(self, manifest: dict, only: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        folders = {int(k): f for k, f in manifest["folders"].items() if only is None or int(k) in only}
        if not folders:
            return self.spark.createDataFrame([], schema.add("bucket", T.IntegerType()))
        by_write: dict[str, list[str]] = {}
        for k, write in folders.items():
            by_write.setdefault(write, []).append(f"{self.path}/data/{write}/bucket={k}")
        rows = None
        for write, paths in sorted(by_write.items()):
            some = self.spark.read.schema(schema).option("basePath", f"{self.path}/data/{write}").parquet(*paths)
            some = some.select(*schema.names, F.col("bucket").cast("int").alias("bucket"))
            rows = some if rows is None else rows.unionByName(some)
        return rows

    def of_sources(self, sources: DataFrame, version: int | None = None) -> DataFrame:
        """The chunks of the sources in a column source_id: only their buckets are read, as Spark finds out when it runs."""
        manifest = self.manifest(version)
        wanted = sources.select(F.col("source_id").alias("s"), bucket_of("source_id", manifest["buckets"]).alias("b")).distinct()
        return self._rows(manifest).join(wanted, (F.col("bucket") == F.col("b")) & F.col("source_id").eqNullSafe(F.col("s")), "left_semi")

    # --- writing ---

    def upsert(self, chunks: DataFrame, sources: DataFrame | None = None) -> int:
        """Replace the documents in sources (source_id; those of chunks, if not given) by what chunks has of them. Returns the new version.

        Chunks that are given twice count once, the one with the smallest hash of its columns.
        """
        first = self.manifest()
        schema, buckets = T.StructType.fromJson(first["schema"]), first["buckets"]
        draft = self._draft(chunks.select(*schema.names), buckets, first["version"] + 1)
        new = self._rows(first | {"folders": draft})
        touched = (sources if sources is not None else new).select("source_id").distinct()
        touched = stored(touched.withColumn("bucket", bucket_of("source_id", buckets)))
        numbers = {r.bucket for r in touched.select("bucket").distinct().collect()} | {int(k) for k in draft}  # as many as buckets at most
        for _ in range(ATTEMPTS):
            base = self.manifest()
            try:
                if not any(int(k) in numbers for k in base["folders"]):
                    version = self._add(base, draft)
                else:
                    version = self._replace(base, numbers, touched, new)
                    for write in set(draft.values()):
                        folder, files = self._file(f"{self.path}/data/{write}")
                        files.delete(folder, True)
                dropped(touched)
                return version
            except Conflict:
                continue
        raise Conflict(f"{self.path} was changed {ATTEMPTS} times by others")

    def delete(self, sources: DataFrame) -> int:
        """Take the documents in sources (source_id) out. Returns the new version."""
        schema = T.StructType.fromJson(self.manifest()["schema"])
        return self.upsert(self.spark.createDataFrame([], schema), sources)

    def _draft(self, chunks: DataFrame, buckets: int, version: int) -> dict[str, str]:
        """The folder of each bucket of the chunks, once each, written without a look at the index."""
        columns, order = chunks.columns, ["bucket", "source_id", "chunk_index"]
        # the slots of a bucket have its remainder
        rows = chunks.withColumn("slot", bucket_of("source_id", buckets * SLOTS)).withColumn("bucket", F.col("slot") % buckets).repartition("slot")
        nth = F.row_number().over(Window.partitionBy("slot", *order).orderBy(F.xxhash64(*columns, "bucket")))  # in the same partitions
        return self._write(rows.withColumn("nth", nth).where("nth = 1").drop("nth", "slot"), version)

    def _write(self, rows: DataFrame, version: int) -> dict[str, str]:
        write = f"{version:012d}-{uuid.uuid4().hex}"
        rows.sortWithinPartitions("bucket", "source_id", "chunk_index").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/data/{write}")
        folder, files = self._file(f"{self.path}/data/{write}")
        settle(self.spark)
        return {n.removeprefix("bucket="): write for s in files.listStatus(folder) if (n := s.getPath().getName()).startswith("bucket=")}

    def _add(self, base: dict, folders: dict[str, str]) -> int:
        self._publish(base["version"] + 1, {"buckets": base["buckets"], "schema": base["schema"], "folders": base["folders"] | folders})
        self._expire()
        return base["version"] + 1

    def _replace(self, base: dict, numbers: set[int], touched: DataFrame, new: DataFrame) -> int:
        old = self._rows(base, numbers)
        gone = touched.select(F.col("source_id").alias("s"), F.col("bucket").alias("b"))
        kept = old.join(gone, (F.col("bucket") == F.col("b")) & F.col("source_id").eqNullSafe(F.col("s")), "left_anti")
        order = ["bucket", "source_id", "chunk_index"]
        rows = kept.unionByName(new.select(kept.columns)).repartitionByRange(*order)
        nth = F.row_number().over(Window.partitionBy(*order).orderBy(F.xxhash64(*kept.columns)))  # in the same partitions
        written = self._write(rows.withColumn("nth", nth).where("nth = 1").drop("nth"), base["version"] + 1)
        return self._add(base | {"folders": {k: f for k, f in base["folders"].items() if int(k) not in numbers}}, written)

    def _expire(self) -> None:
        """Delete what only versions before the last KEEP name."""
        old = self.versions()[:-KEEP]
        used = {(k, f) for v in self.versions()[-KEEP:] for k, f in self.manifest(v)["folders"].items()}
        for version in old:
            try:
                named = self.manifest(version)["folders"].items()
            except Exception:  # noqa: BLE001  another writer has just deleted it
                continue
            for k, f in set(named) - used:
                folder, files = self._file(f"{self.path}/data/{f}/bucket={k}")
                files.delete(folder, True)
            file, files = self._file(f"{self.path}/manifests/{version:012d}.json")
            files.delete(file, False)


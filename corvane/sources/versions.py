"""Numbered manifests in a folder: a version is there whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has taken the version."""


class Versions:
    """The folder at a path, with `manifests/<version>.json`; a manifest says where the data of its version are and never changes."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder, files = self._file(f"{self.path}/manifests")
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n[:1].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What the newest or a given version says, and its number as version."""
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"there is nothing at {self.path}")
        file, files = self._file(f"{self.path}/manifests/{found[-1] if version is None else version:012d}.json")
        stream = files.open(file)
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(raw) | {"version": found[-1] if version is None else version}

    def _publish(self, version: int, manifest: dict) -> None:
        """Give a manifest its number, or raise Conflict."""
        jvm = self.spark._jvm
        temporary, files = self._file(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = files.create(temporary)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final, _ = self._file(f"{self.path}/manifests/{version:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(files.makeQualified(temporary), files.makeQualified(final), none)
        except Exception as e:
            files.delete(temporary, False)
            if not files.exists(final):
                raise
            raise Conflict(f"version {version} of {self.path} is taken") from e

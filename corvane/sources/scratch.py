"""Tables between two steps of a query, written to the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which the file system deletes when the application ends."""
    path = f"{shared_dir(spark)}/corvane-{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df, written once and read back."""
    path = new_path(df.sparkSession, "step")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and broadcasts of finished queries, which stay on disk until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Delete what stored() has written for tables that nothing reads any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)

"""A log of evaluation runs: one table of records, another of how runs ended; rows are only ever added."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import evaluation

RECORDS = "run_id string, strategy string, ordinal long, question_no long, recall double, n_papers long, citation_validity double, retries double, has_citations double, unverified boolean, latency_ms double, failed string"
ENDS = "run_id string, strategies array<string>, questions long, stopped_early boolean, reason string"


def evaluate(questions: DataFrame, strategies: list[tuple], ask: Callable[[DataFrame, tuple], DataFrame], path: str) -> str:
    """Run strategies one after the other over questions (qid), and log what ask(questions, strategy) says of each question. Returns the run's id.

    ask's rows have question_no and what they have of the other columns of RECORDS; failed is the reason of a question that has no answer. A strategy's time, shared by its questions, is their latency, unless the rows have
    one. A failure ends its strategy, and later ones are not asked (the quota is used up); what was complete before it counts.
    """
    spark, run_id, reason, asked = questions.sparkSession, uuid.uuid4().hex, None, []
    n = questions.count()
    for ordinal, strategy in enumerate(strategies):
        start, given = time.monotonic(), ask(questions, strategy)
        target = f"{path}/records/run_id={run_id}/strategy={ordinal}"
        fixed = {"run_id": F.lit(run_id), "strategy": F.lit(strategy[0]), "ordinal": F.lit(ordinal).cast("long")}
        columns = [fixed[c].alias(c) if c in fixed else (F.col(c) if c in given.columns else F.lit(None)).cast(t).alias(c) for c, t in (f.split(" ") for f in RECORDS.split(", "))]
        given.select(columns).write.parquet(f"{target}/rows")
        each = 1000.0 * (time.monotonic() - start) / max(n, 1)
        spark.createDataFrame([(each,)], "each double").write.parquet(f"{target}/time")
        asked.append(strategy[0])
        if failure := spark.read.schema(RECORDS).parquet(f"{target}/rows").where("failed is not null").orderBy("question_no").first():
            reason = failure["failed"]
            break
    spark.createDataFrame([(run_id, asked, n, reason is not None, reason)], ENDS).write.mode("append").parquet(f"{path}/ends")
    return run_id


def records(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The records of a run that count, with stopped_early."""
    rows = None
    (end,) = ends(spark, path).where(F.col("run_id") == run_id).collect()
    for ordinal in range(len(end["strategies"])):
        target = f"{path}/records/run_id={run_id}/strategy={ordinal}"
        each = spark.read.parquet(f"{target}/time").first()["each"]
        some = spark.read.schema(RECORDS).parquet(f"{target}/rows").withColumn("latency_ms", F.coalesce("latency_ms", F.lit(each)))
        rows = some if rows is None else rows.unionByName(some)
    if rows is None:
        rows = spark.createDataFrame([], RECORDS)
    return evaluation.until_quota(rows.withColumn("failed", F.col("failed").isNotNull()))


def ends(spark: SparkSession, path: str) -> DataFrame:
    """run_id, strategies that were asked, questions, stopped_early and the reason of each run."""
    return spark.read.schema(ENDS).parquet(f"{path}/ends")

"""Retrieval and answer metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.sources.scratch import stored

# Name, keyword weight and graph weight of each strategy, in order.
STRATEGIES = [("vector_only", 0.0, 0.0), ("hybrid_light", 0.15, 0.0), ("hybrid", 0.3, 0.0), ("hybrid_heavy", 0.5, 0.0), ("graph_light", 0.3, 0.2), ("graph", 0.3, 0.4), ("graph_heavy", 0.3, 0.6)]


def expected_keywords(questions: DataFrame, n: int = 5) -> DataFrame:
    return questions.withColumn("expected", F.slice(F.array_distinct(T.keywords("question")), 1, n))


def keyword_recall(retrieved: DataFrame, chunks: DataFrame, questions: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """by, recall and n_papers: the share of expected keywords in the joined texts of the retrieved chunks. What was retrieved is stored, so that chunks are not shuffled for few rows."""
    texts = stored(retrieved.select(*by, "rank", "source_id", "chunk_index")).join(chunks.select("source_id", "chunk_index", "text"), ["source_id", "chunk_index"])
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ")
    per = texts.groupBy(*by).agg(T.normalise(ordered).alias("hay"), F.countDistinct("source_id").alias("n_papers"))
    joined = questions.join(per, list(by), "left").withColumn("hay", F.coalesce("hay", F.lit("")))
    hits = F.size(F.filter("expected", lambda k: F.contains(F.col("hay"), T.normalise(k))))
    recall = F.when(F.size("expected") == 0, F.lit(1.0)).otherwise(hits.cast("double") / F.size("expected").cast("double"))
    return joined.select(*by, recall.alias("recall"), F.coalesce("n_papers", F.lit(0)).cast("long").alias("n_papers"))


def citation_validity(cited, retrieved):
    """The share of cited ids that were retrieved; 0 if none is cited."""
    valid = F.size(F.filter(cited, lambda x: F.array_contains(retrieved, x)))
    return F.when(F.size(cited) > 0, valid.cast("double") / F.size(cited).cast("double")).otherwise(F.lit(0.0))


def strategies(names: str | None = None) -> list[tuple[str, float, float]]:
    """The strategies of a comma-separated list, as given, or all of them; an unknown name is an error."""
    known = {name: (name, weight, graph_weight) for name, weight, graph_weight in STRATEGIES}
    wanted = [n.strip() for n in names.split(",")] if names else list(known)
    if unknown := [n for n in wanted if n not in known]:
        raise ValueError(f"unknown strategies {unknown}; there are {list(known)}")
    return [known[n] for n in wanted]


def question_slice(questions: DataFrame, offset: int = 0, limit: int = 0, by: str = "qid") -> DataFrame:
    """Questions in order of by, without the first offset, and then at most limit of them (0: all); an offset past the end is an error."""
    if offset and not questions.count() > offset:
        raise ValueError(f"there is no question after the first {offset}")
    out = questions.orderBy(by).offset(offset)
    return out.limit(limit) if limit else out


def until_quota(records: DataFrame) -> DataFrame:
    """Records (strategy, ordinal, question_no, failed) that were complete when the first failure stopped the run, and stopped_early.

    ordinal numbers strategies; a failure ends its strategy and all later ones. What its strategy has completed counts.
    """
    at = F.struct("ordinal", "question_no")
    first = records.agg(F.min(F.when(F.col("failed"), at)).alias("stop"))
    joined = records.crossJoin(F.broadcast(first))  # one row
    return joined.where(F.col("stop").isNull() | (at < F.col("stop"))).withColumn("stopped_early", F.col("stop").isNotNull()).drop("stop", "failed")


def _rounded_mean(total, n, unit: int, digits: int):
    """total / (unit * n), both integers, rounded half up to so many digits without a binary tie."""
    scale = 10**digits
    return F.expr(f"({2 * scale} * {total} + {unit} * {n}) div ({2 * unit} * {n})").cast("double") / F.lit(float(scale))


#: A recall has five expected keywords at most, so all are whole multiples of one part of this.
RECALL_PARTS = 60


def sweep_summary(records: DataFrame) -> DataFrame:
    """Of strategy, ordinal, recall, n_papers (and latency_ms, if there): the means of each strategy, rounded half up on whole numbers."""
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("recall") * RECALL_PARTS).cast("long")).alias("parts"), F.count_if(F.col("recall") == 1.0).alias("perfect"), F.sum("n_papers").alias("papers")]
    timed = "latency_ms" in records.columns
    sums += [F.round(F.avg("latency_ms"), 2).alias("mean_latency_ms")] if timed else []
    out = records.groupBy("strategy", "ordinal").agg(*sums)
    return out.select("strategy", "ordinal", _rounded_mean("parts", "n", RECALL_PARTS, 4).alias("mean_recall"), "perfect", _rounded_mean("papers", "n", 1, 2).alias("mean_papers"), *(["mean_latency_ms"] if timed else []))


def agent_summary(records: DataFrame) -> DataFrame:
    """One row over recall, citation_validity, retries, has_citations, unverified (and latency_ms, if there); means are null where nothing counts."""
    mean = lambda c: F.round(F.avg(c), 6)
    timed = [mean("latency_ms").alias("avg_latency_ms")] if "latency_ms" in records.columns else []
    return records.agg(F.count(F.lit(1)).alias("questions_completed"), mean("recall").alias("avg_recall"), mean("citation_validity").alias("avg_citation_validity"), mean(F.when(~F.col("unverified"), F.col("citation_validity"))).alias("avg_citation_validity_verified"), mean("retries").alias("avg_retries"), mean("has_citations").alias("citation_rate"), mean(F.col("unverified").cast("double")).alias("unverified_rate"), *timed)


def as_json(summary: DataFrame) -> DataFrame:
    """A summary as JSON; what is null is left out, so no questions give their count alone."""
    return summary.select(F.to_json(F.struct("*")).alias("summary"))

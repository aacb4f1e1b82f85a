"""A corpus pipeline: quality, line deduplication, near duplicates, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and no
others that docs may have. Rows are judged by their text, whole; doc_id, lang, source and n_chars may be null. An empty table
gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from corvane.llm.common import drop_stored, fold, scratch, settle, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: What counts as blank in a line.
BLANKS = " \t\n\x0b\x0c\r"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is trained on labelled rows outside the held-out third.

    Null and empty texts have the score of the bias. Repeated rows are accepted or rejected alike. Without labels all stay.
    """
    model = quality.fit(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return quality.classify(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the lines that ten documents or more have, only the first stays, so that a text with many copies stays once.

    A document that loses lines and keeps nothing but blanks goes; one that was null or blank before stays. The first is the one of
    the smallest doc_id (null before all), then of the smallest position; rows equal in doc_id and text count once and get the same result.
    """
    docs = docs.select(*COLUMNS)
    kept = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs, min_docs=10, min_chars=1, mode="first"))
    lost = F.col("n_dropped") > 0
    text = F.when(lost, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(lost, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    blank = F.translate("kept_text", BLANKS, "") == ""
    return kept.where(~(lost & blank)).select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id (null before all): five-word shingles, similarity 0.8 or more.

    Texts without words have no duplicates. Rows that share a doc_id are one document: one of them stays, with the smallest hash of its text.
    """
    docs = docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id())  # docs is a table: the same for each use
    groups = jaccard_join.join_documents(docs, size=5, percent=80)
    first = stored(groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct())
    settle(spark)  # the shuffle files of the join go
    rows = docs.groupBy("doc_id").agg(F.min_by("__row", F.struct(F.xxhash64("text"), "__row")).alias("__row"))
    rows = rows.join(first, F.col("doc_id").eqNullSafe(F.col("kept")), "left_semi").select("__row")
    return docs.join(rows, "__row", "left_semi").select(*COLUMNS)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null and empty texts stay; repeated rows are judged alike."""
    found = decontaminate.find_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hit_spans") == 0).select(*COLUMNS)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token_ids, n_tokens and round_trips: whether decoding gives the text back.

    Null and empty texts have no tokens. Repeated rows are encoded alike.
    """
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "text", "lang", "source"), path, pattern), path, pattern)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), same.alias("round_trips"))


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_common_lines),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("tokens", tokenized),
]

#: The classifier and the tokenizer are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again; a stage's table goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        drop_stored(*before)
        before = [docs]
    return docs

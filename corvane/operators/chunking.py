"""Overlapping word windows and their payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T


def chunks(docs: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """source_id, chunk_index, text and further columns of docs (source_id, text and others); an empty text has no chunk."""
    step = max(size - overlap, 1)
    w, n = F.col("w"), F.size("w")
    others = [c for c in docs.columns if c not in ("source_id", "text")]
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    split = docs.select("source_id", *others, T.words(F.coalesce("text", F.lit(""))).alias("w"))
    starts = F.when(n > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))  # a filter would split the texts once more
    parts = F.transform(starts, lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(size)), " "))
    return split.select("source_id", F.posexplode(parts).alias("chunk_index", "text"), *others).withColumn("chunk_index", F.col("chunk_index").cast("long"))


def chunk_stats(c: DataFrame) -> DataFrame:
    n = F.length("text")
    return c.agg(F.count(F.lit(1)).alias("n_chunks"), F.expr("percentile(length(text), 0.5)").alias("median_chars"), F.round(F.avg(F.least(F.lit(500), n) / n), 6).alias("shown_share"))


#: Written into every chunk; readers fill in what older ones lack.
SCHEMA_VERSION = 2
#: Characters of a text in which most titles end.
START = 400


def papers(docs: DataFrame) -> DataFrame:
    """Documents as papers: the first words are the title, the language the category, the source the author; none has a date."""
    text = F.coalesce("text", F.lit(""))
    start = T.words(F.substring(text, 1, START))  # of which the last word may be cut
    # white space may come first, and the tenth part is the rest
    title = F.array_join(F.slice(F.when(F.size(start) > 8, start).otherwise(T.words(text, 10)), 1, 8), " ")
    listed = lambda c: F.array_compact(F.array(c)).alias
    return docs.select(F.col("doc_id").cast("string").alias("source_id"), title.alias("title"), F.coalesce("text", F.lit("")).alias("abstract"), listed("source")("authors"), F.col("lang").alias("primary_category"), listed("lang")("categories"), F.lit("").alias("published"))


FIELDS = ("title", "authors", "primary_category", "categories", "published")


def repeated(papers: DataFrame) -> bool:
    """Whether papers share an id."""
    return not papers.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def described(docs: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """Chunks of docs with their fields. As long as no id occurs twice, fields are those of the same row, and no text is shuffled."""
    p = papers(docs)
    if repeated(p):
        return payload(chunks(p.select("source_id", F.col("abstract").alias("text")), size, overlap), p)
    named = F.when(F.col("source_id").isNotNull(), F.struct(*FIELDS))  # a null id has no paper
    return _filled(chunks(p.select("source_id", F.col("abstract").alias("text"), named.alias("p")), size, overlap))


def payload(c: DataFrame, p: DataFrame) -> DataFrame:
    """Chunks with their paper's fields, or defaults where the paper or a field is missing. Of papers with one id the largest by its fields counts."""
    one = p.groupBy("source_id").agg(F.max(F.struct(*FIELDS)).alias("p"))
    return _filled(c.join(one, "source_id", "left"))


def _filled(joined: DataFrame) -> DataFrame:
    published, none = F.coalesce("p.published", F.lit("")), F.array().cast("array<string>")
    return joined.select(
        "text", "source_id", F.coalesce("p.title", F.lit("")).alias("source_title"), "chunk_index", F.coalesce("p.authors", none).alias("authors"), F.coalesce("p.primary_category", F.lit("")).alias("primary_category"),
        F.coalesce("p.categories", none).alias("categories"), published.alias("published"), T.published_year(published).cast("int").alias("published_year"), F.lit(SCHEMA_VERSION).alias("schema_version"),
    )

"""Tables that the engine reads and writes: papers and questions as JSON, the graph, results."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.scratch import stored
from corvane.sources.versions import Versions

PAPERS = "arxiv_id string, title string, abstract string, authors array<string>, published string, pdf_url string, pdf_path string, primary_category string, categories array<string>"
QUESTIONS = "id string, question string, expected_keywords array<string>"
_BROKEN = "_broken"


def _read_json(spark: SparkSession, path: str, schema: str, required: list[str], lines: bool) -> tuple[DataFrame, DataFrame]:
    """Records of a schema, and the text of those that can't be read or lack a required field, with the reason."""
    whole = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("_file"), "value")
    if lines:
        texts = whole.where(F.trim("value") != "").withColumn("record", F.col("value"))
    else:  # a file that can't be read is one broken record, and so is a broken element of an array
        items = F.expr("try_variant_get(try_parse_json(value), '$', 'array<variant>')")
        texts = whole.select("_file", F.explode(F.coalesce(F.transform(items, lambda x: F.to_json(x)), F.array("value"))).alias("record"))
    read = F.from_json("record", f"{schema}, {_BROKEN} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})
    rows = stored(texts.select("_file", read.alias("r")).select("_file", "r.*"))
    lacks = F.lit(False)
    for c in required:
        lacks = lacks | F.coalesce(F.trim(c), F.lit("")).eqNullSafe("")
    fields = [c for c in rows.columns if c not in (_BROKEN, "_file")]
    unread = F.col(_BROKEN).isNotNull()
    broken = rows.where(unread | lacks).select(F.col("_file").alias("file"), F.when(unread, F.lit("not of the schema")).otherwise(F.lit("no " + " or ".join(required))).alias("reason"), F.coalesce(_BROKEN, F.to_json(F.struct(*fields))).alias("record"))
    return rows.where(~(unread | lacks)).select(*fields), broken


def _one_line(c: str) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "\n", " ")


def _named(x: Column, name: str) -> Column:
    """A name that stands alone or in an object."""
    return F.coalesce(F.get_json_object(x, f"$.{name}"), x)


def read_papers(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Papers from JSON arrays (or a record a line), and the records that are none (file, reason, record).

    Titles and abstracts are on one line; missing fields have defaults; dates that can be read become ISO-8601 in UTC, others stay as they are; authors and categories may be objects with
    a name or a term; the first category stands in for a missing main one, and the other way round.
    """
    raw, broken = _read_json(spark, path, PAPERS, ["arxiv_id"], lines)
    listed = lambda c, name: F.array_compact(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: _named(x, name)))
    when = F.expr("try_to_timestamp(published)")
    published = F.coalesce(F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), "published", F.lit(""))
    main, categories = _named(F.nullif(F.trim("primary_category"), F.lit("")), "term"), listed("categories", "term")
    papers = raw.select("arxiv_id", _one_line("title").alias("title"), _one_line("abstract").alias("abstract"), listed("authors", "name").alias("authors"), published.alias("published"), "pdf_url", "pdf_path", main.alias("main"), categories.alias("categories"))
    first = F.coalesce("main", F.try_element_at("categories", F.lit(1)), F.lit(""))
    listed_main = F.when((F.size("categories") == 0) & F.col("main").isNotNull(), F.array("main")).otherwise(F.col("categories"))
    return papers.select("arxiv_id", "title", "abstract", "authors", "published", "pdf_url", "pdf_path", first.alias("primary_category"), listed_main.alias("categories")), broken


def as_papers(read: DataFrame) -> DataFrame:
    """Papers that were read, as the chunking and the graph take them."""
    return read.select(F.col("arxiv_id").alias("source_id"), "title", "abstract", "authors", "primary_category", "categories", "published")


def write_papers(papers: DataFrame, path: str) -> None:
    """A record a line; read_papers(lines=True) gives them back."""
    papers.write.mode("error").json(path)


def read_questions(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Questions (id, question, expected_keywords) and the records that are none."""
    rows, broken = _read_json(spark, path, QUESTIONS, ["id", "question"], lines)
    return rows.withColumn("expected_keywords", F.coalesce("expected_keywords", F.array().cast("array<string>"))), broken


def save_graph(edges: DataFrame, papers: DataFrame, path: str) -> int:
    """A new version of the graph at path: edges, nodes with their types, and the papers' titles. Returns its number; a reader keeps the one that it has."""
    versions, write = Versions(edges.sparkSession, path), uuid.uuid4().hex
    edges.select("src", "relation", "dst").distinct().sort("src", "relation", "dst").write.parquet(f"{path}/data/{write}/edges")
    titles = papers.groupBy("source_id").agg(F.max(F.coalesce("title", F.lit(""))).alias("title"))
    titles.sort("source_id").write.parquet(f"{path}/data/{write}/titles")
    number = (versions.versions() or [0])[-1] + 1
    versions._publish(number, {"write": write})
    return number


def load_graph(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (src, relation, dst) and titles (source_id, title) of the newest or a given version."""
    write = Versions(spark, path).manifest(version)["write"]
    return spark.read.parquet(f"{path}/data/{write}/edges"), spark.read.parquet(f"{path}/data/{write}/titles")


def export_graph(edges: DataFrame, titles: DataFrame, path: str) -> None:
    """A JSON line for each paper: id, title and, by relation, what it is linked with, in order."""
    lists = edges.distinct().groupBy("src", "relation").agg(F.array_sort(F.collect_list("dst")).alias("dst")).groupBy("src").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "dst")))).alias("edges"))
    rows = titles.join(lists, F.col("source_id") == F.col("src"), "full").select(F.coalesce("source_id", "src").alias("id"), "title", "edges")
    rows.sort("id").write.mode("error").json(path)


def import_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges and titles of an exported graph."""
    rows = spark.read.schema("id string, title string, edges map<string, array<string>>").json(path)
    edges = rows.select(F.col("id").alias("src"), F.explode("edges").alias("relation", "found")).select("src", "relation", F.explode("found").alias("dst"))
    return edges, rows.where("title is not null").select(F.col("id").alias("source_id"), "title")


def write_results(results: DataFrame, path: str) -> None:
    """A JSON line for each row; nulls are left out."""
    results.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)

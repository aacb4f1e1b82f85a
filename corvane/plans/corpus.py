"""What the retrieval queries of a session share: the chunk index of a corpus, its questions and its graph, each made at its first use."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import agent, chunking, evaluation, graph, retrieval
from corvane.sources import runs
from corvane.sources.index import Index
from corvane.sources.scratch import new_path, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, dealt to all cores if they lie in fewer splits than there are cores."""
    df, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_id"), "text")


class Corpus:
    """The documents of a folder as papers and the benchmark's texts as questions. Queries read the stored index and graph."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def index(self) -> Index:
        """The index, filled by one upsert: chunks with their paper's fields, embedded."""
        chunks = retrieval.embed(chunking.described(texts(self.spark, self.sf_dir)))
        index = Index(self.spark, new_path(self.spark, "index")).create(chunks.schema)
        index.upsert(chunks)
        return index

    @property
    def chunks(self) -> DataFrame:
        return self.index.read()

    @cached_property
    def questions(self) -> DataFrame:
        q = table(self.spark, self.sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text", F.col("text").alias("question"))
        return stored(retrieval.embed(q))

    @cached_property
    def papers(self) -> DataFrame:
        return chunking.papers(texts(self.spark, self.sf_dir))

    @cached_property
    def edges(self) -> DataFrame:
        return stored(graph.edges(self.papers, graph.concepts(self.papers)))

    @cached_property
    def links(self) -> graph.Links:
        return graph.linked(self.edges)

    def pool(self) -> DataFrame:
        """The candidates of each question, with keyword overlap; found anew by each query."""
        return stored(retrieval.overlap(retrieval.vector_top(self.questions, self.chunks), self.questions, self.chunks))


    def search(self, queries: DataFrame, top: int = 5, weight: float = 0.3) -> DataFrame:
        """qid, rank, source_id, source_title, chunk_index, score and text of the best chunks for each query (qid, query)."""
        q = stored(retrieval.embed(queries.select("qid", F.coalesce("query", F.lit("")).alias("text"), F.coalesce("query", F.lit("")).alias("question"))))
        pool = stored(retrieval.overlap(retrieval.vector_top(q, self.chunks), q, self.chunks))
        hits = retrieval.hybrid(pool, weight, top)
        fields = self.chunks.select("source_id", "chunk_index", F.coalesce("source_title", F.lit("")).alias("source_title"), F.coalesce("text", F.lit("")).alias("text"))
        found = hits.join(fields, ["source_id", "chunk_index"])
        return found.select("qid", "rank", "source_id", "source_title", F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index"), "score", "text")

    def answers(self, questions: DataFrame, model, max_retries: int = 2) -> DataFrame:
        """The loop's outcome for each question (qid, question): retrieval from the index, drafts and verdicts by the model."""
        return agent.run(questions, model, self.search, max_retries)

    def evaluate_retrieval(self, path: str, names: str | None = None, offset: int = 0, limit: int = 0) -> str:
        """Log a run of the strategies of a comma-separated list (or all) over a slice of the questions; returns its id."""

        def ask(questions: DataFrame, strategy: tuple) -> DataFrame:
            _, weight, graph_weight = strategy
            pool = stored(retrieval.overlap(retrieval.vector_top(questions, self.chunks), questions, self.chunks))
            found = graph.expanded(pool, questions, self.chunks, self.links, weight, graph_weight) if graph_weight > 0 else retrieval.hybrid(pool, weight)
            return evaluation.keyword_recall(found, self.chunks, evaluation.expected_keywords(questions)).withColumnRenamed("qid", "question_no")

        questions = stored(evaluation.question_slice(self.questions, offset, limit))
        return runs.evaluate(questions, evaluation.strategies(names), ask, path)

    def evaluate_answers(self, path: str, model, names: str | None = None, offset: int = 0, limit: int = 0, max_retries: int = 2) -> str:
        """Log a run of the loop, its search weighted by each strategy, over a slice of the questions; returns its id. Strategies with a graph search without it."""

        def ask(questions: DataFrame, strategy: tuple) -> DataFrame:
            done = stored(agent.run(questions, model, lambda q: self.search(q, weight=strategy[1]), max_retries))
            return self.metrics(done)

        questions = stored(evaluation.question_slice(self.questions, offset, limit))
        return runs.evaluate(questions, evaluation.strategies(names), ask, path)

    def metrics(self, done: DataFrame) -> DataFrame:
        """question_no, recall, n_papers, citation_validity, retries, has_citations, unverified and failed of the loop's outcomes."""
        rows = done.select("qid", F.explode("found").alias("c")).select("qid", "c.rank", "c.source_id", "c.chunk_index")
        recall = evaluation.keyword_recall(rows, self.chunks, evaluation.expected_keywords(done).select("qid", "expected"))
        validity = evaluation.citation_validity(F.col("cited"), F.coalesce("found.source_id", F.array().cast("array<string>")))
        tagged = T.has_citations(F.col("answer")).cast("double")
        return done.join(recall, "qid").select(F.col("qid").alias("question_no"), "recall", "n_papers", validity.alias("citation_validity"), F.col("retries").cast("double").alias("retries"), tagged.alias("has_citations"), (F.col("verdict") != "approved").alias("unverified"), "failed")

    def answer(self, question: str, model, max_retries: int = 2) -> dict:
        """What a caller gets for one question: question, search_query, answer, sources (without their texts), cited, retry_count, verdict."""
        if len(question) < 3:
            raise ValueError("a question has three characters at least")
        row = self.answers(self.spark.createDataFrame([(0, question)], "qid long, question string"), model, max_retries).first()
        sources = [{k: c[k] for k in ("source_id", "source_title", "chunk_index", "score")} for c in row["found"] or []]
        return {"question": question, "search_query": row["query"], "answer": row["answer"], "sources": sources, "cited": row["cited"], "retry_count": row["retries"], "verdict": row["verdict"], "failed": row["failed"]}


_OPEN: dict[tuple, Corpus] = {}


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus of a folder, the same one as long as its files are the same."""
    files = []
    for name in ("documents", "benchmark"):
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        system = target.getFileSystem(spark._jsc.hadoopConfiguration())
        status = system.getFileStatus(target)
        files += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in (system.listStatus(target) if status.isDirectory() else [status])]
    key = (spark.sparkContext.applicationId, sf_dir, *files)
    if key not in _OPEN:
        for old in [k for k in _OPEN if k[0] != key[0]]:  # of sessions that have ended
            del _OPEN[old]
        _OPEN[key] = Corpus(spark, sf_dir)
    return _OPEN[key]

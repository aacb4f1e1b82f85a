"""The registered queries, each over whole tables; their SQL is in plans/sql.py under the same names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import replies
from corvane.functions import text as T
from corvane.operators import agent, chunking, evaluation, graph, models, retrieval
from corvane.plans.corpus import corpus, documents, table, texts
from corvane.plans.runs import RUNS
from corvane.sources import runs
from corvane.sources.scratch import new_path, stored

KNOWN_IDS = ("0", "1", "2", "3")


def _scored(spark, sf_dir):
    """Questions, indexed chunks and the candidates of each question."""
    c = corpus(spark, sf_dir)
    return c.questions, c.chunks, c.pool()


def _windows(size: int, overlap: int):
    def query(spark, sf_dir):
        c = chunking.chunks(documents(spark, sf_dir), size, overlap)
        return c.select("source_id", "chunk_index", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))

    return query


def chunk_stats(spark, sf_dir):
    return chunking.chunk_stats(chunking.chunks(documents(spark, sf_dir)))


def chunk_payload(spark, sf_dir):
    p = chunking.described(texts(spark, sf_dir))
    joined = lambda c: F.array_join(c, "|").alias(c)
    return p.select(F.md5("text").alias("text_md5"), "source_id", "source_title", "chunk_index", joined("authors"), "primary_category", joined("categories"), "published", "published_year", "schema_version")


def keyword_counts(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.explode(T.keywords("text")).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


def published_year(spark, sf_dir):
    published = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.published_year(published).alias("published_year"))


def hashed_embedding(spark, sf_dir):
    return corpus(spark, sf_dir).chunks.select("source_id", "chunk_index", F.array_join(F.col("v").cast("array<string>"), " ").alias("v"), "norm2")


def vector_topk(spark, sf_dir):
    c = corpus(spark, sf_dir)
    out = retrieval.vector_top(c.questions, c.chunks)
    return out.select("qid", "rank", "source_id", "chunk_index", F.round("sim", 6).alias("sim"))


#: Query vectors that are sent to the executors at once, half a kB each.
VECTORS_AT_ONCE = 4_096


def vector_topk_embeddings(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    q = stored(v.groupBy("label").agg(F.min_by("e", "vec_id").alias("q")))
    sim = F.round(F.aggregate(F.zip_with("q", "e", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 6)
    blocks = max(1, -(-q.count() // VECTORS_AT_ONCE))
    scored = None
    for k in range(blocks):
        some = q.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == k)
        one = v.drop("label").crossJoin(F.broadcast(some)).select(F.col("label").cast("long").alias("label"), "vec_id", sim.alias("sim"))
        scored = one if scored is None else scored.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("sim"), "vec_id"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= 20)


def filtered_vector_topk(spark, sf_dir):
    german = table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("doc_id").cast("string").alias("source_id"))
    c = corpus(spark, sf_dir)
    out = retrieval.vector_top(c.questions, c.index.of_sources(german))
    return out.select("qid", "rank", "source_id", "chunk_index", F.round("sim", 6).alias("sim"))


def keyword_overlap(spark, sf_dir):
    return _scored(spark, sf_dir)[2].select("qid", "source_id", "chunk_index", F.round("kw", 6).alias("kw"))


def _hybrid(weight: float):
    return lambda spark, sf_dir: retrieval.hybrid(_scored(spark, sf_dir)[2], weight)


def doc_frequency(spark, sf_dir):
    return graph.document_frequency(graph.frequencies(chunking.papers(texts(spark, sf_dir)))).select("term", "df")


def tfidf_concepts(spark, sf_dir):
    return graph.concepts(chunking.papers(texts(spark, sf_dir))).select("source_id", "rank", "term", "score")


def kg_edges(spark, sf_dir):
    return corpus(spark, sf_dir).edges


def kg_nodes_stats(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return graph.stats(c.papers, c.edges)


def related_papers(spark, sf_dir):
    _, _, pool = _scored(spark, sf_dir)
    seeds = retrieval.ranked(retrieval.blend(pool, 0.3), 20)
    return graph.related(graph.seed_papers(seeds), corpus(spark, sf_dir).links, 5).select("src", "other", "relatedness", "rank")


def _expanded(graph_weight: float):
    def query(spark, sf_dir):
        q, c, pool = _scored(spark, sf_dir)
        links = corpus(spark, sf_dir).links if graph_weight > 0 else None  # without a weight no graph is made
        return graph.expanded(pool, q, c, links, 0.3, graph_weight)

    return query


def keyword_recall(spark, sf_dir):
    q, c, pool = _scored(spark, sf_dir)
    return evaluation.keyword_recall(retrieval.hybrid(pool, 0.3), c, evaluation.expected_keywords(q)).select("qid", "recall", "n_papers")


def retrieval_sweep(spark, sf_dir):
    """All strategies at once: those without a graph differ by a weight of the same pool, those with one by a weight of the same neighbours."""
    q, c, pool = _scored(spark, sf_dir)
    rows = [(name, k, weight, graph_weight) for k, (name, weight, graph_weight) in enumerate(evaluation.STRATEGIES)]
    all_of = spark.createDataFrame(rows, "strategy string, ordinal long, weight double, graph_weight double")
    key = ("strategy", "ordinal", "qid")
    plain = pool.crossJoin(F.broadcast(all_of.where("graph_weight = 0")))  # a few literal rows
    hybrid = retrieval.ranked(retrieval.blend(plain, F.col("weight")), 5, key)
    seeds, near = graph.neighbour_chunks(pool, q, c, corpus(spark, sf_dir).links, 0.3)
    graphs = F.broadcast(all_of.where("graph_weight > 0"))
    expanded = graph.merged(seeds.crossJoin(graphs), stored(near).crossJoin(graphs), F.col("graph_weight"), by=(*key, "graph_weight"))
    columns = [*key, "rank", "source_id", "chunk_index"]
    found = hybrid.select(columns).unionByName(expanded.select(columns))
    asked = evaluation.expected_keywords(q).select("qid", "expected").crossJoin(F.broadcast(all_of.select("strategy", "ordinal")))
    return evaluation.sweep_summary(evaluation.keyword_recall(found, c, asked, key))


def best_strategy(spark, sf_dir):
    return retrieval_sweep(spark, sf_dir).orderBy(F.desc("mean_recall"), "ordinal").limit(1).select("strategy", "mean_recall")


def _answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    tag = lambda x: F.concat(F.lit("[arxiv:"), x.cast("string"), F.lit("]"))
    return c.select("conv_id", "turn", F.concat("text", F.lit(" "), tag(F.col("conv_id") % 7), F.lit(" and "), tag(F.col("turn") % 3)).alias("draft"))


def citation_validity(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", evaluation.citation_validity(T.cited_ids("draft"), F.array(*map(F.lit, KNOWN_IDS))).alias("validity"))


def extract_citations(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", F.array_join(T.cited_ids("draft"), "|").alias("cited"))


def has_citations(spark, sf_dir):
    """Of drafts that name sources, and of every fifth conversation as it is."""
    plain = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    drafts = _answers(spark, sf_dir).join(plain, ["conv_id", "turn"]).select("conv_id", "turn", F.when(F.col("conv_id") % 5 == 0, F.col("text")).otherwise(F.col("draft")).alias("answer"))
    return drafts.select("conv_id", "turn", T.has_citations("answer").alias("has_citations"))


def structural_check(spark, sf_dir):
    issue = agent.structural_issue(T.cited_ids("draft"), F.array(*map(F.lit, KNOWN_IDS)))
    return _answers(spark, sf_dir).select("conv_id", "turn", F.coalesce(issue["verdict"], F.lit("pass")).alias("verdict"))


def eval_slice(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.length("text").cast("long").alias("n_chars"))
    return evaluation.question_slice(q, 5, 10)


def critic_route(spark, sf_dir):
    """Every check of a draft and where it sends it: structure, then the judge's reply, then the bound on retries."""
    known = F.array(*map(F.lit, KNOWN_IDS))
    drafts = _answers(spark, sf_dir).select("conv_id", "turn", F.when(F.col("conv_id") % 5 == 0, F.lit("no source")).otherwise(F.col("draft")).alias("draft"), (F.col("conv_id") % 3).alias("retries"))
    state = drafts.withColumns({"retrieved": known, "judge_reply": _pick(REPLIES, "conv_id")})
    o = agent.critic(state, 2).select("conv_id", "turn", "outcome.*")
    route = F.when(F.col("verdict").isin("approved", "unverified"), F.lit("end")).when(F.col("verdict") == "needs_retrieval", F.lit("retriever")).otherwise(F.lit("synthesis"))
    return o.select("conv_id", "turn", "verdict", F.col("retries").cast("long").alias("retries"), route.alias("route"))


def quota_cut(spark, sf_dir):
    """Questions that were answered before the quota was used up, in a logged run of two strategies of the loop whose model fails at every sixteenth question."""
    c = corpus(spark, sf_dir)
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    model = models.Failing(models.Scripted(stored(scripted_replies(q))), F.col("qid") % 16 == 9, "429 RESOURCE_EXHAUSTED: requests PerDay")
    path = new_path(spark, "runs")
    run = c.evaluate_answers(path, model, "hybrid_light,hybrid")
    return runs.records(spark, path, run).select("strategy", "ordinal", "question_no", F.round("recall", 6).alias("recall"), F.round("citation_validity", 6).alias("citation_validity"), F.col("retries").cast("long").alias("retries"), "stopped_early")


def contexts(spark, sf_dir):
    """Context of a draft and of its judgement, over all chunks of each document."""
    c = chunking.chunks(documents(spark, sf_dir)).withColumn("source_title", F.concat(F.lit("Paper "), "source_id"))
    rows = c.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "source_id", "source_title", "text"))).alias("found"))
    return rows.select("source_id", F.md5(T.writer_context(F.col("found"))).alias("writer_md5"), F.md5(T.judge_context(F.col("found"))).alias("judge_md5"))


def kg_nodes(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return graph.nodes(c.papers, c.edges)


REPLIES = ['{"faithful": true, "issues": "", "sufficient_context": true}', '```json\n{"faithful": false, "issues": "x"}\n```', 'Verdict: {"faithful": true} as asked', "The draft looks fine.", "[true]", '{"issues": "none"}', '{"faithful": "true"}', '{"faithful": true, "sufficient_context": "no"}']
ERRORS = ["connection reset", '429 retryDelay: "7s"', "RESOURCE_EXHAUSTED PerDay", '429 retryDelay: "200s"', "429 slow down"]


def _pick(values: list[str], by: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


def judge_parse(spark, sf_dir):
    raw = table(spark, sf_dir, "labels").select("doc_id", _pick(REPLIES, "doc_id").alias("raw"))
    return raw.withColumn("j", replies.judge_verdict("raw")).select("doc_id", "j.valid", "j.faithful", "j.sufficient")


def retry_decision(spark, sf_dir):
    errors = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 4).alias("attempt"), _pick(ERRORS, "doc_id").alias("error"))
    return errors.withColumn("d", replies.retry_decision("error", "attempt")).select("doc_id", "d.action", "d.delay")


def message_text(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    plain, none = F.to_json(F.array(text)), F.lit('{"other": 1}')
    blocks = F.to_json(F.array(F.struct(F.lit("text").alias("type"), text.alias("text")), F.struct(F.lit("image").alias("type"), F.lit("no").alias("text"))))
    kind = F.col("turn") % 3
    content = F.when(kind == 0, plain).when(kind == 1, blocks).otherwise(none)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", content.alias("content")).select("conv_id", "turn", replies.message_text("content").alias("text"))


def scripted_replies(questions: DataFrame) -> DataFrame:
    """Scripts of the questions (qid, question): queries are the question, its second half, and its first; drafts and verdicts those of RUNS."""
    spark = questions.sparkSession
    told = [(kind, role, k + 1, t) for kind, run in enumerate(RUNS) for role, texts in zip(("draft", "judge"), run, strict=True) for k, t in enumerate(texts)]
    fixed = F.broadcast(spark.createDataFrame(told, "kind long, role string, call_no long, text string"))  # some twenty rows
    half = "cast(length(question) / 2 as int)"
    asked = ['concat(\'"\', question, \'"\')', f"substring(question, {half} + 1)", f"substring(question, 1, {half})"]
    rewrites = questions.select("qid", F.lit("rewrite").alias("role"), F.posexplode(F.array(*map(F.expr, asked))).alias("k", "text"))
    rewrites = rewrites.select("qid", "role", (F.col("k") + 1).cast("long").alias("call_no"), "text")
    return rewrites.unionByName(questions.withColumn("kind", F.pmod("qid", F.lit(len(RUNS)))).join(fixed, "kind").select("qid", "role", "call_no", "text"))


def _answered(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return corpus(spark, sf_dir).answers(q, models.Scripted(stored(scripted_replies(q))))


def agent_loop(spark, sf_dir):
    """All questions through the loop: rewritten queries, hybrid search of the index, scripted drafts and verdicts that see the passages."""
    joined = lambda c: F.array_join(c, "|")
    return _answered(spark, sf_dir).select("qid", "verdict", "retries", "answer", joined("cited").alias("cited"), joined("found.source_id").alias("retrieved"), F.md5(T.judge_context("found")).alias("context_md5"), "n_rewrite", "n_synthesis", "n_judge")


def agent_eval_summary(spark, sf_dir):
    """Metrics over the loop's answers to all questions."""
    records = corpus(spark, sf_dir).metrics(stored(_answered(spark, sf_dir)))
    return evaluation.agent_summary(records)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [chunk_stats, chunk_payload, keyword_counts, published_year, hashed_embedding, vector_topk, vector_topk_embeddings, filtered_vector_topk, keyword_overlap, doc_frequency, tfidf_concepts, kg_edges, kg_nodes_stats, related_papers, keyword_recall, retrieval_sweep, best_strategy, citation_validity, extract_citations, has_citations, structural_check, judge_parse, retry_decision, message_text, agent_eval_summary, agent_loop, eval_slice, critic_route, quota_cut, contexts, kg_nodes]
    out = {f.__name__: f for f in named}
    out |= {"chunk_windows": _windows(800, 120), "chunk_windows_200": _windows(200, 30)}
    out |= {"hybrid_vector_only": _hybrid(0.0), "hybrid_light": _hybrid(0.15), "hybrid_search": _hybrid(0.3), "hybrid_heavy": _hybrid(0.5)}
    out |= {"graph_expanded_light": _expanded(0.2), "graph_expanded_default": _expanded(0.3), "graph_expanded_heavy": _expanded(0.6), "graph_zero_equals_hybrid": _expanded(0.0)}
    return out

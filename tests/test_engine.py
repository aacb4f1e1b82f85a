"""Chunking, keywords, metrics, verdicts, graph and the agent loop on tiny inputs."""

from pyspark.sql import functions as F

from corvane.functions import replies
from corvane.functions import text as T
from corvane.operators import chunking, evaluation, graph, retrieval
from corvane.plans import queries as plans
from corvane.plans import sql
from corvane.plans.corpus import Corpus


def one(df):
    return df.collect()[0][0]


def test_chunks_overlap(spark):
    text = " ".join(f"word{i}" for i in range(50))
    c = chunking.chunks(spark.createDataFrame([("a", text), ("b", ""), ("c", "x y")], "source_id string, text string"), 20, 5)
    got = {(r.source_id, r.chunk_index): r.text.split() for r in c.collect()}
    assert sorted(got) == [("a", 0), ("a", 1), ("a", 2), ("c", 0)]
    assert got["a", 0][-5:] == got["a", 1][:5] and got["c", 0] == ["x", "y"]


def test_keywords_and_overlap(spark):
    q = spark.createDataFrame([(1, "what is the dense retrieval"), (2, "is it"), (3, "absent term")], "qid long, question string")
    c = spark.createDataFrame([("a", 0, "dense retrieval index")], "source_id string, chunk_index long, text string")
    assert one(q.where("qid = 1").select(T.keywords("question"))) == ["dense", "retrieval"]
    pool = q.crossJoin(c).select("qid", "source_id", "chunk_index")
    assert {r.qid: r.kw for r in retrieval.overlap(pool, q, c).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_judge_verdicts(spark):
    df = spark.createDataFrame(list(enumerate(plans.REPLIES)), "i int, raw string").withColumn("j", replies.judge_verdict("raw"))
    assert [r.j.valid for r in df.orderBy("i").collect()] == [True] * 3 + [False] * 5


def test_retry_decision(spark):
    df = spark.createDataFrame([(e, 0) for e in plans.ERRORS], "error string, attempt int").withColumn("d", replies.retry_decision("error", "attempt"))
    assert [(r.d.action, r.d.delay) for r in df.collect()] == [("raise", 1), ("wait", 7), ("give_up", 1), ("give_up", 200), ("wait", 1)]


def test_citation_metrics(spark):
    ids = F.array(F.lit("a"))
    df = spark.createDataFrame([("x [arxiv:a]",), ("[arxiv:a] [arxiv:b]",), ("none",)], "t string")
    assert [r[0] for r in df.select(evaluation.citation_validity(T.cited_ids("t"), ids)).collect()] == [1.0, 0.5, 0.0]
    assert [r[0] for r in df.select(T.has_citations("t")).collect()] == [True, True, False]


def test_summary_without_verified_answers(spark):
    rows = [(1.0, 1.0, 0.0, 1.0, True), (0.0, 0.0, 2.0, 1.0, True)]
    r = evaluation.agent_summary(spark.createDataFrame(rows, "recall double, citation_validity double, retries double, has_citations double, unverified boolean")).first()
    assert (r.questions_completed, r.unverified_rate, r.avg_citation_validity_verified) == (2, 1.0, None)


def test_graph(spark):
    rows = [("1", "alpha beta", "gamma delta", ["en"], ["s"]), ("2", "alpha beta", "epsilon", ["en", None], ["s", "s"]), ("3", "zeta", "eta theta", ["fr"], []), ("4", "zeta", "iota", ["fr", "x"], None)]
    p = spark.createDataFrame(rows, "source_id string, title string, abstract string, categories array<string>, authors array<string>")
    e = graph.edges(p, graph.concepts(p))
    found = graph.related(spark.createDataFrame([("1",)], "src string"), graph.linked(e), 5).collect()
    assert [r.other for r in found] == ["2"]
    assert graph.stats(p, e).first().papers == 4


def test_every_sql_has_a_query():
    assert set(sql.SQL) <= set(plans.queries())


def test_no_graph_is_made_for_a_weight_of_zero(spark, monkeypatch):
    def made(self):
        raise AssertionError("the graph was made")

    monkeypatch.setattr(Corpus, "links", property(made))
    assert plans.queries()["graph_zero_equals_hybrid"](spark, "/root/testdata/sf0.001").count() > 0


def test_few_candidates_do_not_shuffle_chunks(spark):
    """The texts of a pool are found without a shuffle of all chunks, even if Spark can't tell the pool's size beforehand."""
    from corvane.sources.scratch import stored

    c = stored(spark.createDataFrame([("a", 0, "graph search"), ("b", 0, "other")], "source_id string, chunk_index long, text string"))
    q = stored(spark.createDataFrame([(1, "graph graph search", ["graph"])], "qid long, question string, expected array<string>"))
    pool = spark.createDataFrame([(1, "a", 0, 1), (1, "b", 0, 2)], "qid long, source_id string, chunk_index long, rank long")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found, recall = retrieval.overlap(pool, q, c), evaluation.keyword_recall(pool, c, q)
    assert "SortMergeJoin" not in plan(found) and "SortMergeJoin" not in plan(recall.select("qid", "n_papers"))
    assert sorted((r.source_id, round(r.kw, 6)) for r in found.collect()) == [("a", 0.666667), ("b", 0.0)]
    assert [tuple(r) for r in recall.collect()] == [(1, 1.0, 2)]

"""JSON sources with broken records, the graph's files, and the log of runs."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import evaluation, graph
from corvane.sources import runs, store


def test_papers_with_broken_records(spark, tmp_path):
    good = {"arxiv_id": "1", "title": " A\ntitle ", "abstract": None, "authors": ["x", {"name": "y"}], "published": "2025-06-08T01:33:05+02:00", "categories": [{"term": "cs.CL"}, "cs.LG"]}
    bare = {"arxiv_id": "2", "primary_category": "math", "published": "soon", "extra": 1}
    none = {"title": "no id"}
    (tmp_path / "a.json").write_text(json.dumps([good, bare, none, {"arxiv_id": "3", "authors": "not a list"}]))
    (tmp_path / "b.json").write_text('[{"arxiv_id": "4", "title": ')
    papers, broken = store.read_papers(spark, str(tmp_path / "*.json"))
    got = {r.arxiv_id: r for r in papers.collect()}
    assert sorted(got) == ["1", "2"]
    assert (got["1"].title, got["1"].abstract, got["1"].authors, got["1"].categories, got["1"].primary_category, got["1"].published) == ("A title", "", ["x", "y"], ["cs.CL", "cs.LG"], "cs.CL", "2025-06-07T23:33:05+00:00")
    assert (got["2"].title, got["2"].authors, got["2"].categories, got["2"].primary_category, got["2"].published) == ("", [], ["math"], "math", "soon")
    assert sorted(r.reason for r in broken.collect()) == ["no arxiv_id", "not of the schema", "not of the schema"]
    store.write_papers(papers, str(tmp_path / "again"))
    again, rest = store.read_papers(spark, str(tmp_path / "again"), lines=True)
    assert sorted(map(str, again.collect())) == sorted(map(str, papers.collect())) and rest.count() == 0


def test_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": "a", "question": "why?"}, {"id": "b"}, {"id": "c", "question": "how?", "expected_keywords": ["x"]}]))
    questions, broken = store.read_questions(spark, str(tmp_path / "q.json"))
    assert sorted((r.id, r.expected_keywords) for r in questions.collect()) == [("a", []), ("c", ["x"])]
    assert [(r.reason, json.loads(r.record)["id"]) for r in broken.collect()] == [("no id or question", "b")]


def test_graph_files(spark, tmp_path):
    rows = [("1", "alpha beta", "gamma", ["en", "x"], ["s", "t"]), ("2", "alpha beta", "", ["en"], ["s"]), ("3", "alone", "", [], [])]
    p = spark.createDataFrame(rows, "source_id string, title string, abstract string, categories array<string>, authors array<string>")
    e = graph.edges(p, graph.concepts(p))
    want = sorted(map(tuple, e.select("src", "relation", "dst").collect()))
    path = str(tmp_path / "graph")
    assert [store.save_graph(e, p, path), store.save_graph(e.limit(0), p, path)] == [1, 2]
    edges, titles = store.load_graph(spark, path, 1)
    assert sorted(map(tuple, edges.collect())) == want and titles.count() == 3
    assert store.load_graph(spark, path)[0].count() == 0
    store.export_graph(edges, titles, str(tmp_path / "json"))
    edges2, titles2 = store.import_graph(spark, str(tmp_path / "json"))
    assert sorted(map(tuple, edges2.collect())) == want and sorted(map(tuple, titles2.collect())) == sorted(map(tuple, titles.collect()))
    assert sum(1 for w in want if w[1] == "AUTHORED_BY") == 3


def test_a_run_that_stops_early(spark, tmp_path):
    path, asked = str(tmp_path / "runs"), []

    def ask(questions, strategy):
        asked.append(strategy[0])
        rows = questions.select(F.col("qid").alias("question_no"), F.lit(1.0).alias("recall"), F.lit(2).alias("n_papers"))
        return rows.withColumn("failed", F.when((F.lit(strategy[0]) == "hybrid") & (F.col("question_no") == 3), F.lit("daily quota")))

    questions = spark.range(5).select(F.col("id").alias("qid"))
    run = runs.evaluate(questions, evaluation.strategies("vector_only, hybrid,graph"), ask, path)
    assert asked == ["vector_only", "hybrid"]
    found = runs.records(spark, path, run).collect()
    assert sorted((r.strategy, r.question_no) for r in found) == [("hybrid", i) for i in range(3)] + [("vector_only", i) for i in range(5)]
    assert all(r.latency_ms > 0 and r.stopped_early for r in found)
    whole = runs.evaluate(questions, evaluation.strategies("graph"), ask, path)
    assert {(r.run_id, r.stopped_early, r.reason) for r in runs.ends(spark, path).collect()} == {(run, True, "daily quota"), (whole, False, None)}
    summary = {r.strategy: r for r in evaluation.sweep_summary(runs.records(spark, path, run)).collect()}
    assert (summary["hybrid"].mean_recall, summary["hybrid"].perfect, summary["hybrid"].mean_papers) == (1.0, 3, 2.0) and summary["hybrid"].mean_latency_ms > 0
    with pytest.raises(ValueError, match="unknown strategies"):
        evaluation.strategies("hybrid,other")


def test_no_records_give_their_count_alone(spark):
    none = spark.createDataFrame([], "recall double, citation_validity double, retries double, has_citations double, unverified boolean, latency_ms double")
    assert evaluation.as_json(evaluation.agent_summary(none)).first().summary == '{"questions_completed":0}'


def test_slices(spark):
    q = spark.range(10).select(F.col("id").alias("qid"))
    ids = lambda *a: [r.qid for r in evaluation.question_slice(q, *a).collect()]
    assert (ids(), ids(8, 0), ids(2, 3)) == (list(range(10)), [8, 9], [2, 3, 4])
    with pytest.raises(ValueError, match="no question"):
        ids(10)

"""The loop with retrieval, the seam of models, vector search and related papers against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import replies
from corvane.operators import graph, models, retrieval
from corvane.plans import queries as plans
from corvane.plans import corpus

GOOD, FAKE, BARE = "Yes [arxiv:{source}].", "Yes [arxiv:nowhere].", "Yes."


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    long = " ".join(f"word{i}" for i in range(900))
    docs = [(0, "dense retrieval of passages", "en", "a"), (1, "graph of papers and authors", "en", "b"), (2, None, None, None), (3, f"{long} needle", "fr", "a")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "dense retrieval"), (2, "graph of papers")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return corpus.corpus(spark, str(folder))


def test_scripted_runs(spark, library):
    """Verdict, retries and calls of every kind of run."""
    q = spark.createDataFrame([(i, f"question {i} on retrieval and papers") for i in range(8)], "qid long, question string")
    got = {r.qid: r for r in library.answers(q, models.Scripted(plans.scripted_replies(q))).collect()}
    calls = {i: (r.verdict, r.retries, r.n_rewrite, r.n_synthesis, r.n_judge) for i, r in got.items()}
    assert calls == {
        0: ("approved", 0, 1, 1, 1), 1: ("approved", 1, 1, 2, 1), 2: ("approved", 1, 2, 2, 2), 3: ("unverified", 2, 1, 3, 3),
        4: ("unverified", 2, 1, 3, 3), 5: ("approved", 1, 2, 2, 1), 6: ("unverified", 2, 1, 3, 0), 7: ("unverified", 2, 3, 3, 0),
    }
    assert "Reason: unsupported" in got[3].answer and "malformed JSON" in got[4].answer and "nowhere" in got[6].answer
    assert all(len(r.found) == 4 and set(r.cited) <= {c.source_id for c in r.found} | {"nowhere"} for r in got.values())


def test_the_judge_sees_whole_passages(spark, library):
    """A model that approves only if the last word of a long chunk is in its prompt, after a task that asks it again and again."""

    def make():
        def say(role, prompt):
            if role == "rewrite":
                return ' "needle word5" '
            if role == "draft":
                return [{"type": "text", "text": "It is there [arxiv:3]."}, {"type": "image"}]
            seen = "needle" in prompt.split("Passages:")[1].split("Answer:")[0] and "word899 needle" in prompt
            return '{"faithful": %s}' % str(seen).lower()

        return say

    out = library.answer("where is the needle?", models.PerTask(make))
    assert (out["verdict"], out["cited"], out["search_query"], out["retry_count"]) == ("approved", ["3"], "needle word5", 0)
    assert "3" in {s["source_id"] for s in out["sources"]} and all("text" not in s for s in out["sources"])
    with pytest.raises(ValueError, match="three characters"):
        library.answer("ab", None)


def test_a_failed_call_ends_its_question_alone(spark, library):
    def make():
        def say(role, prompt):
            if "broken" in prompt and role == "draft":
                raise RuntimeError("429 PerDay quota")
            return {"rewrite": "papers", "draft": "See [arxiv:1]", "judge": models.APPROVAL}[role]

        return say

    q = spark.createDataFrame([(1, "a broken one"), (2, "a whole one")], "qid long, question string")
    got = {r.qid: r for r in library.answers(q, models.PerTask(make)).collect()}
    assert (got[1].verdict, got[1].failed) == ("failed", "daily quota: 429 PerDay quota") and got[2].verdict == "approved"


def test_calls_wait_out_rate_limits():
    slept = []

    def after(*errors):
        told = iter(errors)

        def call():
            if (e := next(told, None)) is not None:
                raise RuntimeError(e)
            return "fine"

        slept.clear()
        return models.invoke(call, slept.append, lambda: 0.5)

    assert after() == ("fine", None) and slept == []
    assert after('429 retryDelay: "7s"', "429") == ("fine", None) and slept == [7.5, 2.5]
    assert after(*["429"] * 9) == (None, "attempts used up: 429") and slept == [1.5, 2.5, 4.5]
    assert after("429", "RESOURCE_EXHAUSTED requests_per_day") == (None, "daily quota: RESOURCE_EXHAUSTED requests_per_day") and slept == [1.5]
    assert after('429 retryDelay: "200s"')[1].startswith("wait too long") and slept == []
    assert after("connection reset")[1] == "no rate limit: connection reset" and slept == []


def test_decisions_are_those_of_the_column(spark):
    errors = [*plans.ERRORS, "429 'retryDelay': '2.5s'", "RESOURCE_EXHAUSTED", "429 Requests_Per_Day", ""]
    rows = [(e, a) for e in errors for a in range(5)]
    found = spark.createDataFrame(rows, "e string, a int").select("e", "a", replies.retry_decision("e", "a").alias("d")).collect()
    assert [(r.d.action, r.d.delay) for r in found] == [models.decide(r.e, r.a)[:2] for r in found]


def test_message_texts(spark):
    told = ['"a"', "hello", "12", '["a", {"type": "text", "text": "b"}, {"type": "x", "text": "no"}, 3]', '{"other": 1}', None, "[broken"]
    rows = spark.createDataFrame([(t,) for t in told], "c string").select(replies.message_text("c").alias("t")).collect()
    assert [r.t for r in rows] == ["a", "hello", "12", "ab", "", "", "[broken"]


def brute_top(q, c, pool):
    sim = lambda a, b: float(np.dot(a, b)) / math.sqrt(float(np.dot(a, a)) * float(np.dot(b, b))) if np.dot(a, a) * np.dot(b, b) > 0 else 0.0
    return {k: sorted(((-sim(v, w), s is not None, s or "", i) for s, i, w in c))[:pool] for k, v in q}


def test_vector_top(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CHUNK_TILE", 7)
    monkeypatch.setattr(retrieval, "QUESTION_TILE", 3)
    rng = np.random.default_rng(5)
    vector = lambda: np.pad(rng.integers(0, 3, 4), (0, 60))
    q, c = [(i if i else None, vector()) for i in range(11)], [(f"s{i % 30}" if i % 50 else None, i, vector()) for i in range(200)]
    c.append(("zero", 0, np.zeros(64, int)))
    rows = lambda x: [(*r[:-1], r[-1].tolist(), int((r[-1] ** 2).sum())) for r in x]
    qs = spark.createDataFrame(rows(q), "qid long, v array<long>, norm2 long")
    cs = spark.createDataFrame(rows(c), "source_id string, chunk_index long, v array<long>, norm2 long").repartition(5)
    for block in (100, 4):
        monkeypatch.setattr(retrieval, "QUESTION_BLOCK", block)
        got = retrieval.vector_top(qs, cs, 9).collect()
        want = brute_top(q, c, 9)
        assert sorted((str(r.qid), r["rank"], r.source_id or "", r.chunk_index) for r in got) == sorted((str(k), n + 1, s, i) for k, found in want.items() for n, (_, _, s, i) in enumerate(found))
    assert retrieval.vector_top(qs.limit(0), cs).collect() == [] and retrieval.vector_top(qs, cs.limit(0)).collect() == []


def test_memory_of_a_large_block():
    """16,384 questions against 10,000 chunks: the state stays small, whatever the tiles hold."""
    import tracemalloc

    best, rng = retrieval._Best(4096, 20), np.random.default_rng(1)
    q = rng.random((4096, 64))
    tracemalloc.start()
    for at in range(0, 10_000, retrieval.CHUNK_TILE):
        c = rng.random((min(retrieval.CHUNK_TILE, 10_000 - at), 64))
        places = [(True, b"s%d" % i, True, i) for i in range(at, at + len(c))]
        for start in range(0, len(q), retrieval.QUESTION_TILE):
            best.add(start, q[start : start + retrieval.QUESTION_TILE] @ c.T, places)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and all(len(f) == 20 for f in best.found)


@pytest.mark.parametrize("hub", [1, 3, 10, 1000])
def test_related_papers(spark, hub):
    rng = random.Random(hub)
    nodes = {f"p{i:02d}": sorted({("IN_CATEGORY", "category:all")} | {("AUTHORED_BY", f"author:{rng.randrange(3)}")} | {("MENTIONS", f"concept:{rng.randrange(25)}") for _ in range(rng.randrange(4))}) for i in range(60)}
    edges = spark.createDataFrame([(p, *n) for p, found in nodes.items() for n in found], "src string, relation string, dst string")
    size = {n: sum(n in found for found in nodes.values()) for found in nodes.values() for n in found}
    weight = lambda n: graph.EDGE_WEIGHTS[n[0]] / math.log(size[n] + 1.5) if size[n] > 1 else 0.0
    seeds = ["p00", "p07", "p31"]
    got = graph.related(spark.createDataFrame([(s,) for s in seeds], "src string"), graph.linked(edges, hub), 5).collect()
    want = []
    for s in seeds:
        scores = sorted((-round(math.fsum(weight(n) for n in set(nodes[s]) & set(nodes[o])), 6), o) for o in nodes if o != s)
        want += [(s, o, k + 1, -x) for k, (x, o) in enumerate(itertools.islice(scores, 5)) if x < 0]
    assert sorted((r.src, r.other, r["rank"], r.relatedness) for r in got) == sorted(want)


def test_a_seed_meets_few_papers_of_a_hub(spark):
    """All papers have one category: what is joined for a seed does not grow with them."""
    edges = spark.range(5000).select(F.format_string("p%05d", "id").alias("src"), F.lit("IN_CATEGORY").alias("relation"), F.lit("category:all").alias("dst"))
    links = graph.linked(edges)
    assert links.first.count() == graph.MOST + 1
    found = graph.related(spark.createDataFrame([("p00002",), ("p04000",)], "src string"), links, 5).collect()
    assert {(r.src, r.other) for r in found} == {("p00002", f"p0000{i}") for i in (0, 1, 3, 4, 5)} | {("p04000", f"p0000{i}") for i in range(5)}

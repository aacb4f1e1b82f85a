"""Concepts of papers against brute force, whatever share of the grams is known to all tasks."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.functions.text import CONCEPT_STOPWORDS
from corvane.operators import chunking, graph


def grams(text):
    w = [x for x in re.findall(r"[a-z][a-z0-9\-]{2,}", text.lower()) if x not in CONCEPT_STOPWORDS]
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def papers(spark):
    rng = random.Random(7)
    words = [f"{a}{b}rd" for a in "abcdefghij" for b in "aeiou"] + ["the", "x"]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.choice([0, 1, 5, 30, 200]))) for _ in range(120)]
    rows = [(str(i % 117), "", t) for i, t in enumerate(texts + texts[:20])]  # ids that occur twice, and copies
    return rows, spark.createDataFrame(rows, "source_id string, title string, abstract string")


def brute(rows, top):
    counts = {}
    for source, _, text in rows:
        counts.setdefault(source, Counter()).update(grams(text))
    df = Counter(t for c in counts.values() for t in c)
    found = {}
    for source, c in counts.items():
        scored = [(round(n / c.total() * math.log(len(rows) / df[t]), 12), t) for t, n in c.items() if 2 <= df[t] <= len(rows) / 2]
        found |= {(source, k + 1): x for k, x in enumerate(sorted(scored, reverse=True)[:top])}
    return found, df


@pytest.mark.parametrize("most", [0, 5, 40, 10_000])
def test_concepts(spark, most):
    rows, p = papers(spark)
    want, _ = brute(rows, 12)
    got = {(r.source_id, r["rank"]): (r.score, r.term) for r in graph.concepts(p, 12, most).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 2e-12 for k in want)


def test_document_frequency(spark, monkeypatch):
    monkeypatch.setattr(graph, "AT_ONCE", 10)  # a task passes a term on many times
    rows, p = papers(spark)
    _, df = brute(rows, 12)
    got = {r.term: r.df for r in graph.document_frequency(graph.frequencies(p)).collect()}
    assert got == {t: n for t, n in df.items() if 2 <= n <= len(rows) / 2}


def test_few_candidates_need_a_look_up(spark):
    """What is looked up by a shuffle is a small part of all grams, and nothing is if all frequencies are known."""
    rows, p = papers(spark)
    f = graph.frequencies(p)
    all_grams = sum(len(grams(t)) for _, _, t in rows)
    count = lambda most: graph.candidates(p, f, 12, most).where("df is null").count()
    assert count(10_000) == 0 and count(200) < all_grams / 2


def test_titles(spark):
    texts = ["", "a b", "  a b c d e f g h i j", " a\tb\nc d e f g h i", "a b c d e f g h ", None, " " * 500 + "a b c d e f g h i", "x" * 300 + " " + "y" * 300 + " b c d e f g h", "a b c d e f g " + "z" * 500, "a b c d e f g " + "z" * 500 + " h"]
    p = chunking.papers(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string"))
    assert [r.title for r in p.orderBy(F.col("source_id").cast("int")).collect()] == [" ".join((t or "").split()[:8]) for t in texts]


def test_largest_hubs_are_not_met(spark):
    """Who shares a category of all papers alone with a seed comes after those who share a concept, so the category is not followed, and the rows are those of brute force."""
    n = 400
    rows = [(f"p{i:03d}", "IN_CATEGORY", "category:all") for i in range(n)] + [(f"p{i:03d}", "MENTIONS", f"concept:{i % 20}") for i in range(n)]
    links = graph.linked(spark.createDataFrame(rows, "src string, relation string, dst string"), hub=10)
    seeds = spark.createDataFrame([("p007",), ("p399",)], "src string")
    hubs = links.near.join(seeds, "src", "left_semi")
    none = spark.createDataFrame([], "src string, other string, own double")
    assert {(r.src, r.dst) for r in graph.met(hubs, none, 5).collect()} == {("p007", "concept:7"), ("p399", "concept:19")}
    gain = round(0.25 / math.log(n + 1.5) + 1 / math.log(20 + 1.5), 6)
    got = [(r.src, r.other, r.relatedness) for r in graph.related(seeds, links, 5).orderBy("src", "rank").collect()]
    assert got == [("p007", f"p{7 + 20 * k:03d}", gain) for k in range(1, 6)] + [("p399", f"p{19 + 20 * k:03d}", gain) for k in range(5)]


@pytest.mark.parametrize("most", [0, 40])
def test_grams_of_one_paper_are_not_looked_up(spark, most):
    """No gram of two papers is missed, and of those of one paper hardly any is looked up."""
    rows, p = papers(spark)
    unique = [(f"u{i}", "", " ".join(f"q{i}x{j}" for j in range(30))) for i in range(60)]  # 59 grams each, in one paper
    p = p.unionByName(spark.createDataFrame(unique, p.schema))
    f = graph.frequencies(p)
    looked_up = graph.candidates(p, f, 12, most).where("df is null").select("term").distinct()
    false = looked_up.join(f.of, "term", "left_anti").count()
    assert false < 0.15 * 60 * 59
    known, least = graph._known(f, most)
    rare = f.of.where(F.col("df") < least)
    bits = graph._rare(f, least)
    slots = [r.h & (8 * len(bits) - 1) for r in rare.select(F.xxhash64("term").alias("h")).collect()]
    assert slots and all(bits[s >> 3] >> (s & 7) & 1 for s in slots)


def test_packed_sums(spark):
    """What tasks pass on comes back whole, also in many parts and portions."""
    sums = Counter({"a": 2, "a b": 1, "ünü": 3, "zz9 q-1": 1})
    packed = graph._packed(sums, 3)
    assert sum((Counter(dict(zip(t["term"].to_pylist(), t["n"].to_pylist()))) for t in graph._unpacked(packed)), Counter()) == sums
    total = Counter()
    for batch in graph._frequent([packed, graph._packed(Counter({"a": 1, "a b": 1}), 5)]):
        total.update(dict(zip(batch["term"].to_pylist(), batch["df"].to_pylist())))
    assert total == {"a": 3, "a b": 2, "ünü": 3} and not list(graph._frequent([]))


def test_fields_without_a_shuffle_of_texts(spark):
    """Chunks get their fields from their own row, and by a join if papers share an id: the same rows as by a join always."""
    schema = "doc_id long, text string, lang string, source string"
    docs = [(i, " ".join(f"w{k}" for k in range(7 * i)), "de" if i % 2 else None, f"s{i % 3}") for i in range(9)] + [(None, "no id", "en", "s"), (20, None, "en", "s"), (21, "  x　y ", "en", None)]
    for rows in (docs, [*docs, (3, "again", "fr", "t")]):
        d = spark.createDataFrame(rows, schema)
        whole = chunking.chunks(d.select(F.col("doc_id").cast("string").alias("source_id"), "text"), 20, 5)
        want = sorted(map(str, chunking.payload(whole, chunking.papers(d)).collect()))
        described = chunking.described(d, 20, 5)
        assert sorted(map(str, described.collect())) == want
        if rows is docs:
            assert "Exchange" not in described._jdf.queryExecution().executedPlan().toString()


def test_white_space(spark):
    """Every white space of Unicode parts words, and nothing else does."""
    from corvane.functions import text as T

    rows = [(i, f"a{chr(i)}b") for i in range(1, 0x3100)]
    two = {r.i for r in spark.createDataFrame(rows, "i long, t string").where(F.size(T.words("t")) == 2).select("i").collect()}
    assert two == {i for i in range(1, 0x3100) if chr(i).isspace()}

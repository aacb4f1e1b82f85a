"""Language identification and quality against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import language_id, quality

SCRIPTS = {
    "de": "Der schnelle braune Fuchs springt über den faulen Hund und läuft dann durch den großen Wald zurück nach Hause",
    "en": "The quick brown fox jumps over the lazy dog and then runs through the large forest on its way back home",
    "el": "Η γρήγορη καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί και μετά τρέχει μέσα από το μεγάλο δάσος",
    "ru": "Быстрая коричневая лиса прыгает через ленивую собаку и потом бежит через большой лес обратно домой",
    "ko": "빠른 갈색 여우가 게으른 개를 뛰어넘고 나서 큰 숲을 지나 집으로 돌아간다",
    "zh": "敏捷的棕色狐狸跳过了那只懒惰的狗然后穿过大森林回到了自己的家里",
    "ja": "すばやい茶色の狐がのろまな犬を飛び越えてから大きな森を通って家に帰る",
}


def naive_phrases(training: bytes, text: bytes) -> int:
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in training:
            size += 1
        at, n = at + size, n + 1
    return n


@pytest.mark.parametrize("block", [3, 16, 256])
def test_phrases_are_longest_matches(block):
    rng = random.Random(block)
    training = {"a": "".join(rng.choices("abé ", k=300)), "b": "".join(rng.choices("abcß ", k=200))}
    texts = ["".join(rng.choices("abcdé ", k=rng.randrange(400))) for _ in range(40)] + [training["a"], training["a"][5:250], "", "a" * 500]
    counts, sizes = language_id.Parser(training, block).phrases(texts)
    for k, name in enumerate(sorted(training)):
        assert counts[k].tolist() == [naive_phrases(language_id.letters(training[name]), language_id.letters(t)) for t in texts]
    assert sizes.tolist() == [len(language_id.letters(t)) for t in texts]


def test_scripts_of_many_languages():
    parser = language_id.Parser(SCRIPTS)
    halves = {k: v[: len(v) * 2 // 3] for k, v in SCRIPTS.items()}
    assert parser.predict(list(SCRIPTS.values()))[0] == list(SCRIPTS)
    assert language_id.Parser(halves).predict([v[len(v) // 3 :] for v in SCRIPTS.values()])[0] == list(SCRIPTS)


def test_sample_has_whole_texts_of_few_rows(spark):
    rows = [(1, f"text {i} " * (4_000 if i == 3 else 1), "xx") for i in range(50)] + [(2, None, "xx"), (3, "no", None), (4, "held out", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.sample(docs, F.col("doc_id") != 4, rows=10)
    parts = got["xx"].split("\n")
    assert set(got) == {"xx"} and len(parts) == 10 and set(parts) <= {t for _, t, _ in rows} and not any("text 3 text" in p for p in parts)
    assert language_id.sample(docs.limit(0), F.lit(True)) == {}


def test_names_that_clash(spark):
    docs = spark.createDataFrame([("The quick fox", 1, 2, 3), (None, 1, 2, 3)], "text string, SCORE int, `a.b` int, Lang_Pred int")
    out = language_id.predict(docs, SCRIPTS)
    assert out.columns == ["text", "a.b", "lang_pred", "score"]
    assert [r.lang_pred for r in out.collect()] == ["en", "und"]
    scored = quality.classify(docs, quality.Model(np.zeros((1 << quality.BUCKET_BITS, quality.DIM)), np.zeros((quality.DIM, 2)), np.zeros(2)))
    assert scored.columns == ["text", "a.b", "Lang_Pred", "score", "predicted"] and {r.score for r in scored.collect()} == {0.5}


def test_gradients():
    rng = np.random.default_rng(1)
    batch = quality.Batch(["aa bb aa cc", "cc dd", "", "aa aa aa"], np.array([1, 0, 1, 0]))
    table, weights, bias = rng.normal(size=(len(batch.rows), 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    _, *grads = batch.loss_and_gradients(table, weights, bias)
    for value, grad in zip((table, weights, bias), grads, strict=True):
        for at in list(np.ndindex(value.shape))[:40]:
            losses = []
            for step in (1e-5, -1e-5):
                value[at] += step
                losses.append(batch.loss_and_gradients(table, weights, bias)[0])
                value[at] -= step
            assert abs((losses[0] - losses[1]) / 2e-5 - grad[at]) < 1e-6


def test_pieces_give_the_same_score():
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "x"], k=rng.randrange(1, 300))) for _ in range(30)] + [None, "", " "]
    model = quality.train([t for t in texts if t], [k % 2 for k, t in enumerate(texts) if t])
    assert np.allclose(quality.Scorer(model, 40)(texts), quality.Scorer(model)(texts), atol=1e-6)


def test_fit_learns_held_out_rows(spark):
    rng = random.Random(6)
    good = [" ".join(rng.choices(["river", "stone", "light", "field", "cloud"], k=20)) for _ in range(60)]
    bad = [" ".join(rng.choices(["BUY", "NOW", "!!!", "CHEAP", "x9"], k=20)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i, _ in rows] + [(0, None), (None, 1)], "doc_id long, quality int")
    held = F.col("doc_id") % 3 == 1
    scored = quality.classify(docs, quality.fit(docs, labels, ~held)).where(held).collect()
    assert all(r.predicted == int(r.doc_id < 60) for r in scored)
    assert quality.classify(docs.limit(2), quality.fit(docs.limit(0), labels, F.lit(True))).first().score == 0.5

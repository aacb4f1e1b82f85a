"""The suffix tree of the language model, against brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.llm import suffix_tree_lm


def brute_scores(rows, least_count, least_gain, depth=3, discount=0.6):
    """Scores of all texts, by back-off through the retained contexts, token by token."""

    def tokens(t):
        return ["<s>", *t.lower().split(), None]

    pairs, words = defaultdict(Counter), Counter()
    for t, train in rows:
        w = tokens(t) if train else []
        words.update(w[1:])
        for i in range(1, len(w)):
            for d in range(1, min(depth, i) + 1):
                pairs[tuple(w[i - d : i])][w[i]] += 1
    n, v = sum(words.values()), len(words)
    nodes = {}

    def p_of(context, word):
        for d in range(len(context) + 1):
            state = context[d:]
            if state in nodes:
                seen, factor = nodes[state]
                return seen[word] if word in seen else factor * p_of(state[1:], word)
        return (words[word] + 1) / (n + v + 1)

    for context in sorted(pairs, key=len):
        total = sum(pairs[context].values())
        seen = {w: (c - discount) / total for w, c in pairs[context].items() if c >= least_count}
        above = {w: p_of(context[1:], w) for w in seen}
        rest, rest_above = (1 - min(sum(x.values()), 1 - 1e-6) for x in (seen, above))
        kl = sum(p * math.log(p / above[w]) for w, p in seen.items()) + rest * math.log(rest / rest_above)
        if seen and total * kl >= least_gain:
            nodes[context] = (seen, rest / rest_above)
    out = {}
    for t, _ in rows:
        w = tokens(t)
        out[t] = sum(math.log10(p_of(tuple(w[max(0, i - depth) : i]), w[i])) for i in range(1, len(w)))
    return out, len({len(c) for c in nodes})


@pytest.mark.parametrize("cached", [0, 40, 1_000_000])
def test_scores(spark, cached):
    rng = random.Random(9)
    phrases = [" ".join(rng.choices([f"w{i}" for i in range(40)], k=6)) for _ in range(12)]
    texts = [" ".join(rng.choices(phrases, k=rng.randrange(6)) + rng.choices(["x", "y", "w1", "w2"], k=rng.randrange(5)) + [f"only{i}"]) for i in range(120)]
    rows = [(t, i % 4 != 0) for i, t in enumerate(texts)] + [("", True)]
    want, lengths = brute_scores(rows, 3, 2.0)
    assert lengths == 3
    docs = spark.createDataFrame(rows, "text string, train boolean")
    got = suffix_tree_lm.score(docs, F.col("train"), cached=cached, frequent=10).collect()
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r.score, want[r.text], rel_tol=1e-9, abs_tol=1e-9)


def test_contexts_of_small_share_stay(spark):
    """A phrase told four times is learnt, however large the rest of the corpus is."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    phrase = "alpha beta gamma delta epsilon"
    rows = [(i, " ".join(rng.choices(words, k=3000)), True) for i in range(100)]
    rows += [(1000 + i, f"{phrase} {rng.choice(words)}", True) for i in range(4)] + [(2000, phrase, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = suffix_tree_lm.score(docs, F.col("train")).where("doc_id = 2000").first()
    assert got.score - got.base_score > 10

"""Chat examples from reply trees, against plain recursion."""

import hashlib
import random

from pyspark.sql import functions as F

from corvane.llm import reply_trees

SCHEMA = "id string, parent string, tree string, role string, text string, score double, PATH string"


def brute_paths(messages, paths):
    """Texts of the chosen paths by (root, rank)."""
    by_id = {m[0]: m for m in messages}
    children = {}
    for m in messages:
        children.setdefault(m[1] if m[1] in by_id else None, []).append(m)
    out = {}
    for root in children.get(None, []):
        found, todo = [], [[root]]
        while todo:
            p = todo.pop()
            below = children.get(p[-1][0], []) if p[-1][0] is not None else []
            todo += [[*p, m] for m in below]
            if not below:
                found.append((sum(m[5] or 0 for m in p) / len(p), p))
        found.sort(key=lambda x: (-round(x[0], 9), -len(x[1])))
        out[root[0]] = [(s, [(m[3] or "", m[4] or "") for m in p]) for s, p in found]
    return out


def test_best_paths_of_forests(spark):
    rng = random.Random(7)
    hostile = ["", None, "<|im_end|>", "<|", "<\\|x", "<\\\\|im_start|>assistant", "a\nb", "€<", "|im_end|>"]
    messages, at = [], 0
    for tree in range(6):
        ids = []
        for _ in range(rng.choice([1, 2, 40, 90])):
            parent = rng.choice(ids[-3:]) if ids else rng.choice([None, "elsewhere"])
            messages.append((f"m{at}", parent, f"t{tree}", rng.choice(["user", "assistant", None, "a\\n\nb<|"]), rng.choice([*hostile, f"text {at}"]), rng.choice([None, rng.random()]), "x"))
            ids.append(f"m{at}")
            at += 1
    want = brute_paths(messages, 2)
    circle = [("c1", "c2", "t", "user", "x", 1.0, "x"), ("c2", "c1", "t", "user", "x", 1.0, "x"), ("c3", "c2", "t", "user", "x", 1.0, "x")]
    rows = [*messages, *circle, messages[0], messages[0]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    out = reply_trees.examples(df, paths=2).collect()
    got = {}
    for r in out:
        assert r.part == 0
        turns = list(reply_trees.turns_of(r.formatted))
        learnt = [reply_trees.unescaped(r.formatted[a:b]) for a, b in zip(r.loss_spans[::2], r.loss_spans[1::2], strict=True)]
        assert learnt == [t for role, t in turns if role == "assistant"]
        assert (r.n_turns, r.n_chars) == (len(turns), len(r.formatted))
        got.setdefault(r.root, {})[r.path] = turns
    assert len(got) == len(want)
    left = [dict(v) for v in got.values()]
    for paths in want.values():
        means = sorted((s for s, _ in paths), reverse=True)[:2]
        chosen = [p for s, p in paths if s >= means[-1] - 1e-9]
        match = next(g for g in left if all(t in chosen for t in g.values()) and len(g) == len(means) and g[1] in [p for s, p in paths if s >= means[0] - 1e-9])
        left.remove(match)


def test_long_threads_in_parts(spark, monkeypatch):
    monkeypatch.setattr(reply_trees, "TURNS", 7)
    rows = [(c, t, ["user", "assistant"][t % 2], f"turn {t} <|im_end|>") for c, n in ((1, 1), (2, 100), (None, 3), (3, 15)) for t in range(n)] + [(3, None, None, None), (3, 4, "user", "turn 4 <|im_end|>"), (3, 4, "user", "another")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    written = reply_trees.examples(reply_trees.thread(df, "conv_id", "turn"))
    assert {(r.tree, r.part) for r in written.collect()} == {(1, 0), (None, 0), *((2, k) for k in range(0, 100, 7)), *((3, k) for k in range(0, 18, 7))}
    got = {r.tree: r for r in reply_trees.read_back(written).collect()}
    for c in (1, 2, None, 3):
        turns = sorted(((t is not None, t or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or "") for conv, t, role, text in rows if conv == c), key=lambda x: x[:4])
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[4]}\n" for t in turns).encode()).hexdigest()
        said = "".join(t[4] for t in turns if t[2] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.formatted_chars == sum(len(x.formatted) for x in written.where(F.col("tree").eqNullSafe(c)).collect())


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert reply_trees.read_back(reply_trees.examples(reply_trees.thread(none, "conv_id", "turn"))).collect() == []

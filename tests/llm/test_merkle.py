"""The Merkle manifest, against a plain recursive one."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path(levels, at):
    """Siblings, level by level, of a leaf."""
    found = []
    for level in levels[:-1]:
        run = at // 16 * 16
        found += [d for i, d in enumerate(level[run : run + 16]) if run + i != at]
        at //= 16
    return found


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([d for *_, d, _ in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    out = []
    for s in order:
        for i, (*_, d, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            out.append((r[0], s, d, trees[s][-1][0], "".join(path(trees[s], i) + path(top, order.index(s)))))
    return top[-1][0], out


def rows_of(sizes, rng):
    rows = [(i, f"s{k}" if k else None, rng.choice(["en", None]), rng.randrange(9), f"text {i} é") for k, n in enumerate(sizes) for i in rng.sample(range(10 * n), n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [300, 1, 16, 257], [5000, 40], [3] * 40])
def test_roots_and_proofs(spark, sizes):
    rng = random.Random(len(sizes))
    rows = rows_of(sizes, rng)
    rows += [rows[0]] * 3 + [(None, "s1", None, None, None), (None, None, "en", 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("Tree", F.lit("x")).repartition(5)
    m = merkle.manifest(docs, [F.col(c) for c in FIELDS], "source", "doc_id")
    root, want = brute(rows)
    assert m.root.hex() == root
    found = merkle.proofs(m).withColumn("folded_root", merkle.folded(F.col("digest"))).collect()
    assert sorted((str(r.key), str(r.tree), r.digest.hex(), r.subroot.hex(), r.proof.hex()) for r in found) == sorted((str(k), str(s), d, h, p) for k, s, d, h, p in want)
    assert all(r.folded_root.hex() == root for r in found)
    inner = sum(len(level) for k in {r[1] for r in rows} for level in levels_of([leaf(r) for r in rows if r[1] == k])[1:])
    assert m.nodes.count() == inner


def test_another_leaf_leads_elsewhere(spark):
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.col("id").cast("string").alias("text"))
    m = merkle.manifest(docs, [F.col("text")], "source", "doc_id", keep={"other": F.unhex(F.sha2(F.lit("forged").cast("binary"), 256))})
    assert not merkle.proofs(m, ["other"]).where(merkle.folded(F.col("other")) == F.lit(m.root)).count()


def test_partial_parents_pass_a_full_table(spark, monkeypatch):
    """Leaves in no order at all, of which a task keeps few parents open."""
    monkeypatch.setattr(merkle, "OPEN", 3)
    rng = random.Random(4)
    digests = [sha(str(i)) for i in range(1000)]
    events = [("t", 1, i // 16, 1000, 1 << (i % 16), bytes.fromhex(d)) for i, d in enumerate(digests)]
    whole = {}
    while events:
        rng.shuffle(events)
        parents, events_next = merkle._Parents(), []
        for e in events:
            parents.merge(*e)
            if len(parents.open) > merkle.OPEN:
                events_next += [(tree, level, at, n, have, kids) for (tree, level, at), (have, kids, n) in parents.open.items()]
                parents.open = {}
        events_next += [(tree, level, at, n, have, kids) for (tree, level, at), (have, kids, n) in parents.open.items()]
        whole |= {(level, at): digest.hex() for _, level, at, _, _, _, digest in parents.whole}
        events = sorted(events_next, key=lambda e: e[:3])
        merkle.OPEN += 50  # rounds bring the parts of a parent together
    levels = levels_of(digests)
    assert whole == {(k, i): d for k, level in enumerate(levels) if k for i, d in enumerate(level)}


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    m = merkle.manifest(none, [F.col("text")], "source", "doc_id")
    assert m.root is None
    assert merkle.proofs(m).withColumn("folded_root", merkle.folded(F.col("digest"))).collect() == []

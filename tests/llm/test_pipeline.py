"""Stages of the corpus pipeline against plain versions."""

import random
from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as pipeline  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Kept_Text int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", None if t is None else len(t), 7) for i, t in texts], DOCS)


def test_common_lines_keep_their_first(spark):
    text = "\n".join(" ".join(f"w{n}x{k}" for k in range(12)) for n in range(4))
    rows = [(i, text) for i in range(5, 17)] + [(i, f"only here {i}\n shared LINE\v") for i in range(20, 32)] + [(40, None), (41, ""), (42, "\v"), (None, "Shared line")]
    where = defaultdict(list)
    for d, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if key := line.strip(" \t\n\v\f\r").lower():
                where[key].append((-1 if d is None else d, n))
    first = {k: min(v) for k, v in where.items() if len({d for d, _ in v}) >= 10}
    want = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for n, x in enumerate(lines) if first.get(x.strip(" \t\n\v\f\r").lower(), (-1 if d is None else d, n)) == (-1 if d is None else d, n)]
        if len(kept) == len(lines):
            want.append((d, t))
        elif "\n".join(kept).strip(" \t\n\v\f\r"):
            want.append((d, "\n".join(kept)))
    got = pipeline.without_common_lines(spark, frame(spark, rows), "")
    assert got.columns == pipeline.COLUMNS
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(want, key=key)
    assert pipeline.without_common_lines(spark, frame(spark, rows).limit(0), "").count() == 0


def test_one_of_each_group_stays(spark):
    rng = random.Random(8)
    base = rng.choices([f"w{i}" for i in range(80)], k=90)
    rows = [(3, " ".join(base)), (3, " ".join(base)), (9, " ".join(base))]
    for i in range(20, 35):
        edited = list(base)
        edited[rng.randrange(90)] = "changed"
        rows.append((i, " ".join(edited)))
    rows += [(50 + i, " ".join(rng.choices([f"v{k}" for k in range(500)], k=60))) for i in range(5)] + [(60, None), (61, ""), (62, "")]
    rows = [(d, t) for d, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    label = [d for d, _ in rows]
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    want = sorted({d for (d, _), x in zip(rows, label, strict=True) if d == x})
    docs = spark.createDataFrame([(d, t, "en", "x", 1, 7) for d, t in rows], DOCS)
    assert sorted(r.doc_id for r in pipeline.one_of_each_group(spark, docs, "").collect()) == want


def test_benchmarks_and_tokens(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(14))
    spark.createDataFrame([("a", item), ("b", None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, f"x {item} y"), (2, "clean text"), (3, None), (4, " ".join(f"q{i}" for i in range(9)))]
    kept = pipeline.without_benchmarks(spark, frame(spark, rows), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    coded = pipeline.tokenized(spark, kept, str(tmp_path)).collect()
    assert all(r.round_trips and r.n_tokens == len(r.token_ids) for r in coded) and {r.doc_id: r.n_tokens for r in coded}[3] == 0


def test_quality_goes_by_label(spark, tmp_path):
    rows = [(i, "good plain words here " * 5 if i % 2 else "BUY!! NOW!! CHEAP!! " * 5) for i in range(60)]
    spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = pipeline.good_quality(spark, frame(spark, rows), str(tmp_path))
    assert kept.columns == pipeline.COLUMNS and sorted(r.doc_id for r in kept.collect()) == list(range(1, 60, 2))

"""Empty tables, and columns that have the names of results, for operators and stages."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import bpe, decontaminate, fill_middle, language_id, line_dedup, quality, substring_dedup, suffix_tree_lm, warc

TOKENS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
MODEL = quality.train(["plain words here"] * 5 + ["BUY!! NOW!!"] * 5, [1] * 5 + [0] * 5)


def with_lines(d):
    return line_dedup.drop_lines(d, line_dedup.keep_bitmaps(d, min_docs=2))


OPERATORS = {
    "op1": (lambda d: language_id.predict(d, {"aa": "ana banana"}), {"lang_pred", "score"}),
    "op2": (with_lines, {"kept_text", "n_lines", "n_dropped"}),
    "op3": (lambda d: bpe.decode(bpe.encode(d, *TOKENS), *TOKENS), {"token_ids", "decoded"}),
    "op4": (lambda d: suffix_tree_lm.score(d, F.lit(True)), {"n_tokens", "n_known", "train_tokens", "base_score", "score"}),
    "op6": (lambda d: quality.classify(d, MODEL), {"score", "predicted"}),
    "op7": (lambda d: substring_dedup.remove_repeats(d, window=50), {"kept_text", "n_words", "removed_spans"}),
    "op10": (lambda d: decontaminate.find_contamination(d, d.sparkSession.createDataFrame([("i", "one two three")], "item_id string, text string")), {"n_words", "hit_spans", "items"}),
    "op13": (fill_middle.fill_in_middle, {"n", "form", "prefix_chars", "middle_chars", "output"}),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_names_of_results_and_no_rows(spark, name):
    operate, results = OPERATORS[name]
    extra = [c.upper() if i % 2 else c.title() for i, c in enumerate(sorted(results))]
    schema = ", ".join(["doc_id long", "text string", "`a.b` string", *(f"`{c}` string" for c in extra)])
    rows = [(1, "one two three", "x", *["old"] * len(extra)), (None, None, None, *[None] * len(extra)), (1, "one two three", "x", *["old"] * len(extra))]
    docs = spark.createDataFrame(rows, schema)
    out = operate(docs)
    assert len(out.columns) == len(set(out.columns)) == 3 + len(results) and results < set(out.columns)
    got = out.select("doc_id", "text", "`a.b`", *sorted(results)).collect()
    assert sorted((str(r.doc_id), str(r.text), str(r["a.b"])) for r in got) == sorted((str(r[0]), str(r[1]), str(r[2])) for r in rows)
    assert all("old" not in [r[c] for c in results] for r in got)
    assert operate(docs.limit(0)).collect() == []


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none, "file://" + str(tmp_path), payload=True).collect() == []


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_without_rows(spark, tmp_path, name):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i", "one two three")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert out.collect() == []
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns

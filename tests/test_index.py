"""The chunk index: replacing, deleting, several writers, what is read and written; and streams that feed it."""

import threading

import pytest
from pyspark.sql import functions as F

from corvane.sources import index as store
from corvane.streaming import ingest

SCHEMA = "source_id string, chunk_index long, text string"


def chunks(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(index, version=None):
    return sorted((str(r.source_id), r.chunk_index, r.text) for r in index.read(version).collect())


@pytest.fixture
def index(spark, tmp_path):
    return store.Index(spark, str(tmp_path / "index")).create(chunks(spark, []).schema, 32)


def test_a_document_is_replaced_whole(spark, index):
    assert content(index) == []
    index.upsert(chunks(spark, [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "x"), (None, 0, "none"), ("b", 0, "x")]))
    index.upsert(chunks(spark, [("a", 0, "short")]))
    assert content(index) == [("None", 0, "none"), ("a", 0, "short"), ("b", 0, "x")]
    index.upsert(chunks(spark, []), spark.createDataFrame([(None,)], "source_id string"))
    index.upsert(chunks(spark, [("c", 0, "new")]), spark.createDataFrame([("c",), ("b",)], "source_id string"))
    assert content(index) == [("a", 0, "short"), ("c", 0, "new")]
    index.delete(spark.createDataFrame([("a",), ("absent",)], "source_id string"))
    assert content(index) == [("c", 0, "new")]
    for _ in range(3):
        index.upsert(chunks(spark, [("c", 0, "new")]))
    assert content(index) == [("c", 0, "new")] and len(index.versions()) == store.KEEP + 1 or len(index.versions()) == store.KEEP


def test_old_versions_stay_readable(spark, index):
    first = index.upsert(chunks(spark, [("a", 0, "one"), ("b", 0, "x")]))
    index.upsert(chunks(spark, [("a", 0, "two")]))
    assert content(index, first) == [("a", 0, "one"), ("b", 0, "x")]
    assert content(index) == [("a", 0, "two"), ("b", 0, "x")]


def test_a_small_batch_leaves_other_buckets(spark, tmp_path):
    index = store.Index(spark, str(tmp_path / "wide")).create(chunks(spark, []).schema, 200)
    index.upsert(chunks(spark, [(f"s{i}", 0, "x" * 50) for i in range(1000)]))
    before = index.manifest()["folders"]
    index.upsert(chunks(spark, [("s1", 0, "y"), ("s2", 0, "z")]))
    after = index.manifest()["folders"]
    assert before.keys() == after.keys() and len(before) > 190
    assert sum(before[k] != after[k] for k in before) == 2
    assert index.read().count() == 1000


def test_a_lost_write_does_not_count(spark, index, monkeypatch):
    index.upsert(chunks(spark, [("a", 0, "one")]))

    def broken(*_):
        raise OSError("lost")

    monkeypatch.setattr(index, "_publish", broken)
    with pytest.raises(OSError, match="lost"):
        index.upsert(chunks(spark, [("a", 0, "two")]))
    monkeypatch.undo()
    assert content(index) == [("a", 0, "one")]
    index.upsert(chunks(spark, [("b", 0, "x")]))
    assert content(index) == [("a", 0, "one"), ("b", 0, "x")]


def test_a_slower_writer_starts_again(spark, index, monkeypatch):
    """Another writer publishes after this one has read its base, in the same bucket."""
    other, publish, met = store.Index(spark, index.path), index._publish, []

    def late(version, manifest):
        if not met:
            met.append(other.upsert(chunks(spark, [("a", 0, "other"), ("b", 0, "theirs")])))
        publish(version, manifest)

    monkeypatch.setattr(index, "_publish", late)
    index.upsert(chunks(spark, [("a", 0, "mine"), ("c", 0, "x")]))
    assert content(index) == [("a", 0, "mine"), ("b", 0, "theirs"), ("c", 0, "x")]
    assert index.versions()[-1] == met[0] + 1


def test_two_writers_at_once(spark, index):
    def write(name):
        for k in range(3):
            store.Index(spark, index.path).upsert(chunks(spark, [(f"{name}{k}", 0, name), ("both", 0, name)]))

    writers = [threading.Thread(target=write, args=(n,)) for n in "pq"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    found = content(index)
    assert [x[0] for x in found] == ["both", "p0", "p1", "p2", "q0", "q1", "q2"] and index.versions()[-1] == 7


def test_sources_read_their_buckets_only(spark, tmp_path):
    index = store.Index(spark, str(tmp_path / "pruned")).create(chunks(spark, []).schema, 64)
    index.upsert(chunks(spark, [(f"s{i}", 0, "x" * 50) for i in range(2000)]))
    wanted = spark.createDataFrame([("s5",), ("s6",)], "source_id string")
    path = str(tmp_path / "wanted")
    wanted.write.parquet(path)
    found = index.of_sources(spark.read.parquet(path).where("source_id <> 'zzz'"))
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.source_id for r in found.collect()) == ["s5", "s6"]


DOCS = "doc_id long, text string, version long, deleted boolean"


def test_batches_skip_replace_and_delete(spark, tmp_path):
    index = ingest.open_index(spark, str(tmp_path / "index"))
    say = lambda *rows: ingest.apply(spark.createDataFrame(rows, DOCS), index, 4, 1)
    assert say((1, "a b c d e", 1, None), (2, None, 1, None), (3, "x y", 1, False), (3, "newer", 2, False), (None, "no id", None, None)) == {"replaced": 3, "deleted": 0, "skipped": 1}
    version = index.versions()[-1]
    assert say((1, "a b c d e", 1, None), (3, "newer", 2, None), (3, "late", 1, None), (9, None, 1, True)) == {"replaced": 0, "deleted": 0, "skipped": 3}
    assert index.versions()[-1] == version
    assert say((3, "late", 1, None)) == {"replaced": 0, "deleted": 0, "skipped": 1}
    assert say((1, "short", 3, None), (3, None, 3, True), (4, "new", None, None)) == {"replaced": 2, "deleted": 1, "skipped": 0}
    assert content(index) == [("1", 0, "short"), ("4", 0, "new"), ("None", 0, "no id")]
    assert say((1, "", 4, None)) == {"replaced": 1, "deleted": 0, "skipped": 0}
    assert content(index) == [("4", 0, "new"), ("None", 0, "no id")]
    assert all(len(r.v) == 64 for r in index.read().collect())


def test_a_stream_that_starts_again(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("source", "index", "checkpoint"))
    schema = "doc_id long, text string"
    for rows in ([(1, "a b c d e"), (2, None), (3, "x y")], [(3, "z y"), (1, "a b"), (4, "new")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(spark, source, schema, path, checkpoint, 4, 1).awaitTermination()
    index = store.Index(spark, path)
    want = [("1", 0, "a b"), ("3", 0, "z y"), ("4", 0, "new")]
    assert content(index) == want
    version = index.versions()[-1]
    ingest.ingest(spark, source, schema, path, checkpoint, 4, 1).awaitTermination()  # nothing new
    assert (content(index), index.versions()[-1]) == (want, version)
    spark.read.schema(schema).parquet(source).where(F.col("text") == "new").coalesce(1).write.parquet(f"{source}2")
    ingest.ingest(spark, f"{source}2", schema, path, f"{checkpoint}2", 4, 1).awaitTermination()  # a replay by another query
    assert (content(index), index.versions()[-1]) == (want, version)


def test_first_chunks_are_written_once(spark, index, monkeypatch):
    """Chunks for empty buckets lie nowhere but in the index, and a draft that was merged with others is gone."""
    columns, stored = [], store.stored
    monkeypatch.setattr(store, "stored", lambda df: columns.append(df.columns) or stored(df))
    index.upsert(chunks(spark, [(f"s{i}", k, "x") for i in range(50) for k in range(3)] + [("s1", 1, "x")]))
    assert content(index) == sorted((f"s{i}", k, "x") for i in range(50) for k in range(3))
    index.upsert(chunks(spark, [("s1", 0, "y")]))
    assert not any("text" in c for c in columns)
    data, files = index._file(f"{index.path}/data")
    assert len(files.listStatus(data)) == 2 and content(index).count(("s1", 0, "y")) == 1

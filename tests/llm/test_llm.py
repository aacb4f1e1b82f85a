"""The text operators on small fixtures, against brute force."""

import base64
import gzip
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, common, decontaminate, jaccard_join, language_id, line_dedup, quality, substring_dedup, suffix_tree_lm, topk, warc

DOCS = "doc_id long, text string, lang string, kept_text string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, near copies, a shared passage, and columns with clashing names."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choices(words, k=70))
    rows = [(0, None, None, "a"), (None, "only text", "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, "a")]
    base = rng.choices(words, k=120)
    for i in range(10, 30):
        edited = list(base)
        edited[rng.randrange(120)] = "changed"
        rows.append((i, " ".join(edited), "en", "x"))
    for i in range(30, 50):
        rows.append((i, f"Common Line\n{' '.join(rng.choices(words, k=30))} {passage}\n common line ", "fr", "x"))
    rows += [(60, "  ".join(base * 40), "en", "x")] * 2
    return spark.createDataFrame(rows, DOCS)


def brute_windows(rows, size):
    first, out = {}, {}
    key = lambda d: -(2**63) if d is None else d
    for d, t in rows:
        w = (t or "").split()
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            first[g] = min(first.get(g, key(d)), key(d))
    for d, t in rows:
        w = (t or "").split()
        gone = {j for i in range(len(w) - size + 1) if first[tuple(w[i : i + size])] < key(d) for j in range(i, i + size)}
        out[d, t] = (len(w), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("hot", [1, 2_000])
def test_substrings(docs, hot):
    want = brute_windows([(r.doc_id, r.text) for r in docs.collect()], 50)
    got = substring_dedup.remove_repeats(docs, hot_docs=hot).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.kept_text) == want[r.doc_id, r.text]


def test_foreign_segments():
    rng = random.Random(1)
    text = [rng.choice(b"ab").to_bytes() for _ in range(200)]
    index = substring_dedup.Index([text[:150], text[100:]], np.array([7, 3]), 6)
    lane = [rng.choice(b"ab").to_bytes() for _ in range(90)]
    got = index.least_documents([np.array([index.codes.get(w, -1) for w in lane])])[0]
    for i, g in enumerate(got.tolist()):
        hits = [d for d, s in ((7, text[:150]), (3, text[100:])) if any(s[j : j + 6] == lane[i : i + 6] for j in range(len(s) - 5))]
        assert g == (min(hits) if hits else np.iinfo(np.int64).max)


def test_components(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))} if w else set()

    key = lambda d: -(2**63) if d is None else d
    sets = [shingles(t) for _, t in rows]
    label = [key(d) for d, _ in rows]
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                same = rows[i][0] == rows[j][0] and a and b
                if (a and b and 100 * len(a & b) >= 85 * len(a | b)) or same:
                    label[i] = label[j] = min(label[i], label[j])
    want = sorted((key(d), len(s), x) for (d, _), s, x in zip(rows, sets, label, strict=True))
    got = sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in jaccard_join.join_documents(docs).collect())
    assert got == want


@pytest.mark.parametrize(("seed", "frequent"), [(1, 3_000), (2, 5)])
def test_components_of_edited_copies(spark, seed, frequent):
    """With a low bound most shingles are frequent, so the sets are found by their pairs of shingles."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]

    def edited(text, edits):
        out = list(text)
        for _ in range(edits):
            at, how = rng.randrange(len(out)), rng.random()
            out[at : at + (how < 0.8)] = [] if how < 0.15 else [rng.choice(words)]
        return out

    texts = []
    for length, with_original in ((60, True), (110, True), (110, False), (30, True)):
        original = [rng.choice(words) for _ in range(length)]
        near = [edited(original, rng.randrange(1, 7)) for _ in range(60)]
        second = [edited(rng.choice(near), rng.randrange(1, 4)) for _ in range(25)]  # copies of copies share their edits
        texts += [original] * with_original + near + second
    rng.shuffle(texts)
    sets = [{tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))} for w in texts]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 100 * len(a & b) >= 85 * len(a | b)]
    want = list(range(len(texts)))
    before = None
    while want != before:
        before = want[:]
        for i, j in links:
            want[i] = want[j] = min(want[i], want[j])
    assert 40 < len(set(want)) < len(texts) - 40
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    if frequent == 5:
        ranks = jaccard_join.shingle_ranks(docs.select(F.col("doc_id").alias("doc"), "text"), 4, frequent)
        often = [sum(int(ranks(h[None])[0]) > ranks.often for h in jaccard_join.distinct(jaccard_join.shingles([" ".join(w).encode()], 4)[0])) for w in texts]
        assert sum(often) > sum(map(len, sets)) / 2
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_documents(docs, frequent=frequent).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, want, strict=True))}


def test_many_copies_and_long_texts(spark):
    """5,000 copies of one edit each link with their original, and two texts of 100,000 words with each other."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    original = rng.choices(words, k=60)
    rows = [(0, " ".join(original))]
    for i in range(1, 5001):
        text = list(original)
        text[rng.randrange(60)] = f"only{i}"
        rows.append((i, " ".join(text)))
    long = rng.choices(words, k=100_000)
    rows += [(9_000, " ".join(long)), (9_001, " ".join([*long[:50_000], "other", *long[50_000:]])), (9_002, " ".join(long[:70_000]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.component_id for r in jaccard_join.join_documents(docs, frequent=50).collect()}
    assert got == {**{i: 0 for i in range(5001)}, 9_000: 9_000, 9_001: 9_000, 9_002: 9_002}


def test_leaders_of_each_size():
    rng = random.Random(3)
    rows = [(k, rng.randrange(40), rng.choice([20, 24, 30, 31, 50, 200])) for k in range(12) for _ in range(rng.randrange(1, 25))]
    want = {}
    for k in range(12):
        leaders = []
        for _, doc, n in (r for r in rows if r[0] == k):
            fitting = [(d, m) for d, m in leaders if 100 * min(n, m) >= 80 * max(n, m)]
            for d, _ in fitting:
                if d != doc:
                    want[d, doc] = want.get((d, doc), 0) + 1
            leaders += [] if fitting else [(doc, n)]
        assert len(leaders) <= 4
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["key", "doc", "n"])
    for step in (7, len(rows)):  # lists that cross batches have the same leaders
        got = {}
        for out in jaccard_join._stars((batch.slice(i, step) for i in range(0, len(rows), step)), 80):
            for r in out.to_pylist():
                got[r["a"], r["b"]] = got.get((r["a"], r["b"]), 0) + r["single"] + r["paired"]
        assert got == want


def test_copies_within_a_longer_text(spark):
    """A longer text that holds all of a group leaves the group a family, whose pairs are not looked up by key."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    original = [rng.choice(words) for _ in range(70)]
    texts = [original + [rng.choice(words) for _ in range(40)]]
    for _ in range(80):
        text = list(original)
        for at in rng.sample(range(len(text)), 2):
            text[at] = rng.choice(words)
        texts.append(text)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    want, before = list(range(len(texts))), None
    while want != before:
        before = want[:]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 100 * len(a & b) >= 80 * len(a | b):
                    want[i] = want[j] = min(want[i], want[j])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.join_documents(docs, size=5, percent=80).collect()}
    assert got == dict(enumerate(want))


@pytest.mark.parametrize("mode", ["all", "first"])
def test_lines(docs, mode):
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    places = {}
    for d, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if k := line.strip(" \t\n\r\v\f").lower():
                places.setdefault(k, []).append((-(2**63) if d is None else d, n))
    common = {k: min(v) for k, v in places.items() if len({d for d, _ in v}) >= 10}
    got = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs, mode=mode)).collect()
    assert len(got) == docs.count()
    for r in got:
        lines = (r.text or "").split("\n")
        kept = [x for n, x in enumerate(lines) if (k := x.strip(" \t\n\r\v\f").lower()) not in common or (mode == "first" and common[k] == (r.doc_id, n))]
        assert (r.n_lines, r.n_dropped, r.kept_text) == (len(lines), len(lines) - len(kept), "\n".join(kept))


def test_contamination(spark, docs):
    items = spark.createDataFrame([("b", "CHANGED w1"), ("c", " ".join(["Common", "line"])), ("d", None), (None, "w1"), ("e", ""), ("f", docs.where("doc_id = 12").first().text)], "item_id string, text string")
    want = {}
    parts = [(r.item_id, [x.decode() for x in decontaminate.words(r.text.encode())]) for r in items.where("item_id is not null and text is not null").collect()]
    for r in docs.collect():
        w = [x.decode() for x in decontaminate.words((r.text or "").encode())]
        hit, found = set(), set()
        for name, p in parts:
            n = min(len(p), 10)
            for a in range(len(p) - n + 1) if p else ():
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == p[a : a + n]:
                        hit |= set(range(i, i + n))
                        found.add(name)
        want[r.doc_id, r.text] = (len(w), len(hit), sorted(found))
    for limit in (8 << 20, 10):
        for r in decontaminate.find_contamination(docs, items, slice_chars=limit).collect():
            spans = r.hit_spans
            assert (r.n_words, sum(spans[1::2]) - sum(spans[::2]), r["items"]) == want[r.doc_id, r.text]
    none = decontaminate.find_contamination(docs, items.limit(0)).collect()
    assert all(r.hit_spans == [] and r["items"] == [] for r in none)


def test_tokens(spark, docs):
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    odd = [("".join(rng.choice("ab'sé 1\n\t\x1c\x85　漢😀<|endoftext|>") for _ in range(rng.randrange(200))),) for _ in range(200)]
    df = docs.select("text").unionByName(spark.createDataFrame(odd + [("x" * 30_000,)], "text string"))
    for r in bpe.decode(bpe.encode(df, path, P.PATTERN), path, P.PATTERN).collect():
        assert r.token_ids == encoder.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_archives(spark, tmp_path):
    rows = [(1, "u", "same"), (5, "u 2", "same"), (5, None, "same"), (3, "v", None), (4, "v", ""), (None, "x", "only"), (7, "é\r\ny", "long " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/archive"
    files = warc.write(warc.mark_duplicates(pages), folder, archive_bytes=1000)
    got = warc.read(warc.normalise(files, folder), folder).collect()
    assert len(got) == len(rows)
    best = {"same": 5, "": 4}
    by = sorted((str(r.page_id), r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in got)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        last = best.get(html or "", page)
        want.append((str(page), "response" if last == page else "revisit", len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), None if last == page else last))
    assert by == sorted(want, key=lambda x: x[:4])
    assert len({r.record_id for r in got}) == len(rows)
    ids = {r.record_id: r.page_id for r in got if r.record_type == "response"}
    assert all(ids[r.refers_id] == r.refers_to for r in got if r.record_type == "revisit")
    assert warc.round_trip(pages.limit(0), folder).count() == 0


def test_damaged_archives(spark, tmp_path):
    folder = f"file://{tmp_path}"
    pages = spark.createDataFrame([(1, "u", "one page"), (2, "u", "another"), (3, "u", "another")], "page_id long, url string, html string")
    archives = warc.normalise(warc.write(warc.mark_duplicates(pages).coalesce(1), folder), folder).collect()
    assert sum(r.records for r in archives) == 3
    path = archives[0].path
    table = spark.createDataFrame(archives)
    rows = warc.read(table, folder)
    warc.check_revisits(rows)
    with pytest.raises(ValueError):
        warc.check_revisits(rows.where("page_id <> 3"))
    with open(path, "rb") as f:
        whole = f.read()
    side = open(path + ".idx").read()
    raw = gzip.decompress(whole)
    # another payload of the same length, and an index that tells another record
    for content, index in [(raw.replace(b"one page", b"one pace"), None), (raw, side.replace("response", "revisit"))]:
        members = [gzip.compress(x + b"\r\n\r\n") for x in re.split(rb"\r\n\r\n(?=WARC/|$)", content) if x]
        at = np.cumsum([0] + [len(m) for m in members]).tolist()
        lines = [x.split("\t") for x in (index or side).splitlines()]
        with open(path, "wb") as f:
            f.write(b"".join(members))
        with open(path + ".idx", "w") as f:
            f.write("".join(f"{a}\t{len(m)}\t{x[2]}\t{x[3]}\n" for a, m, x in zip(at, members, lines)))
        with pytest.raises(Exception, match="is damaged|does not fit"):
            warc.read(table, folder).collect()


def test_a_page_that_everyone_serves(spark, tmp_path):
    """20,000 copies of one page, and archives that are normalised twice, as by a task that is run again."""
    pages = spark.range(20_100).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.when(F.col("id") < 20_000, F.lit("the same page " * 5)).otherwise(F.col("id").cast("string")).alias("html"))
    path = str(tmp_path / "pages")
    pages.write.parquet(path)
    found = warc.round_trip(spark.read.parquet(path)).groupBy("record_type", "refers_to").count().collect()
    assert {(r.record_type, r.refers_to, r["count"]) for r in found} == {("response", None, 101), ("revisit", 19_999, 19_999)}
    folder = "file://" + str(tmp_path / "archives")
    written = common.stored(warc.write(warc.mark_duplicates(spark.read.parquet(path)), folder))
    once, twice = (warc.normalise(written, folder).collect() for _ in range(2))
    assert sorted(once) == sorted(twice) and sum(r.records for r in once) == 20_100


@pytest.mark.parametrize(("shard", "block"), [(8_192, 8 << 20), (5, 8 << 20), (9, 128)])
def test_top_k(spark, monkeypatch, shard, block):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(60, None), (61, [float("nan")] * 8), (62, [None, 1.0]), (63, [0.5]), (100, [0.25] * 8), (100, [0.25] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    rows = [(i, np.pad(np.floor(1024 * np.array(v)), (0, 8 - len(v)))) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, a in [(i, v) for i, v in {i: v for i, v in rows}.items() if i % 20 == 0]:
        s = sorted((-int(a @ b), i) for i, b in rows if i != q)[:10]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    got = topk.top_k(df.where("vec_id % 20 = 0"), df, block_bytes=block).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_language_and_quality(spark, docs):
    texts = {"aa": "ana banana anana " * 50, "bb": "kolo loko koko olo " * 50}
    rows = spark.createDataFrame([(1, "banana ana!"), (2, "KOLO koko"), (3, None), (4, "12 ?"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(rows, texts).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["aa", "bb", "und", "und", "und"] and 0.5 < got[1][1] <= 1
    assert all(r.lang_pred == "und" for r in language_id.predict(rows, {}).collect())
    good, bad = [f"plain words here number {i}" for i in range(40)], [f"BUY!! NOW!! CHEAP!! N{i}!!" for i in range(40)]
    model = quality.train(good + bad, [1] * 40 + [0] * 40)
    scored = quality.classify(spark.createDataFrame([("plain words again",), ("CHEAP!! BUY!!",), (None,), ("",)], "text string"), model).collect()
    assert [r.predicted for r in scored[:2]] == [1, 0] and scored[2].score == scored[3].score


def test_model(spark, docs):
    import math
    from collections import Counter

    out = suffix_tree_lm.score(docs, F.col("lang") == "en").collect()
    learnt = Counter()
    for r in docs.where("lang = 'en'").collect():
        learnt.update([*(r.text or "").lower().split(), None])
    n, v = sum(learnt.values()), len(learnt)
    assert len(out) == docs.count()
    for r in out:
        w = [*(r.text or "").lower().split(), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(learnt[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((learnt[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9, abs_tol=1e-9)
        assert r.score <= 1e-9
    assert suffix_tree_lm.score(docs.limit(0), F.lit(True)).count() == 0


def test_empty_tables(docs):
    none = docs.limit(0)
    assert jaccard_join.join_documents(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert line_dedup.drop_lines(none, line_dedup.keep_bitmaps(none)).count() == 0
    assert topk.top_k(none.selectExpr("doc_id as vec_id", "array(1.0D) as embedding"), none.selectExpr("doc_id as vec_id", "array(1.0D) as embedding")).count() == 0


@pytest.mark.parametrize("percent", [0, 50, 101])
def test_thresholds_without_keys(docs, percent):
    with pytest.raises(ValueError, match="percent"):
        jaccard_join.join_documents(docs, percent=percent)

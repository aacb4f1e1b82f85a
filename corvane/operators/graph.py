"""A typed knowledge graph of papers, and retrieval that follows it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nlargest
from math import inf, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corvane.functions import text as T
from corvane.operators import chunking, retrieval
from corvane.sources.scratch import dropped, settle, stored

# The weight of a shared neighbour by relation; any other relation weighs 0.5.
EDGE_WEIGHTS = {"MENTIONS": 1.0, "AUTHORED_BY": 0.8, "IN_CATEGORY": 0.25}
#: Papers of a node from which on it is a hub, and related papers that can be asked for.
HUB, MOST = 200, 20
#: Grams whose df is sent to all tasks, grams that a task sums up before it passes them on, and rows that it returns at once.
KNOWN, AT_ONCE, ROWS_AT_ONCE = 200_000, 400_000, 50_000
#: Characters of text for each partition of a shuffle of grams.
PART_CHARS = 16 << 20
#: Bits of the map of grams in two papers at least, as a power of 2.
SLOT_BITS = 28


def _lowered(papers: DataFrame) -> DataFrame:
    """source_id and texts: a paper's title and abstract in lower case. Papers with one id are one with several texts."""
    each = papers.select("source_id", F.lower(F.concat_ws(" ", "title", "abstract")).alias("text"))
    if not chunking.repeated(papers):
        return each.select("source_id", F.array("text").alias("texts"))
    return each.groupBy("source_id").agg(F.collect_list("text").alias("texts"))


_CONCEPT_WORDS, _NO_CONCEPTS = re.compile(r"[a-z][a-z0-9\-]{2,}"), frozenset(T.CONCEPT_STOPWORDS)


def _grams(texts: list[str], found: set | Counter) -> set | Counter:
    """found with each concept word and pair of neighbours, as often as it occurs if found counts."""
    for text in texts:
        w = [x for x in _CONCEPT_WORDS.findall(text) if x not in _NO_CONCEPTS]
        found.update(w)
        found.update(map(" ".join, zip(w, w[1:], strict=False)))
    return found


def _packed(papers_of: Counter, parts: int) -> pa.RecordBatch:
    """part, size, terms and n: for each part that has some of the terms, these terms and their papers, compressed."""
    dealt = [([], []) for _ in range(parts)]
    for term, n in papers_of.items():
        terms, ns = dealt[xxh64_intdigest(term) % parts]
        terms.append(term)
        ns.append(n)
    rows = [(k, "\n".join(terms).encode(), np.array(ns, np.int64).tobytes()) for k, (terms, ns) in enumerate(dealt) if terms]
    pack = lambda x: pa.compress(x, codec="zstd", asbytes=True)
    columns = zip(*[(k, len(terms), pack(terms), len(n), pack(n)) for k, terms, n in rows], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], names=_PACKED_NAMES)


_PACKED = "part int, terms_size long, terms binary, n_size long, n binary"
_PACKED_NAMES = ["part", "terms_size", "terms", "n_size", "n"]


def _unpacked(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    for row in batch.to_pylist():
        terms = pa.decompress(row["terms"], row["terms_size"], codec="zstd", asbytes=True).decode().split("\n")
        n = np.frombuffer(pa.decompress(row["n"], row["n_size"], codec="zstd", asbytes=True), np.int64)
        yield pa.table({"term": terms, "n": n})


def _sums_of_papers(parts: int):
    """The papers that have each term, summed over AT_ONCE terms or so in a task, packed by the part of the term."""

    def run(batches):
        papers_of = Counter()
        for batch in batches:
            for texts in batch.column("texts"):
                papers_of.update(_grams(texts.as_py(), set()))
                if len(papers_of) >= AT_ONCE:
                    yield _packed(papers_of, parts)
                    papers_of.clear()
        if papers_of:
            yield _packed(papers_of, parts)

    return run


def _frequent(batches):
    """term and df of the terms of a part that two papers have at least."""
    sums, waiting, rows = None, [], 0
    added = lambda: pa.concat_tables(([sums] if sums else []) + waiting).group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"])
    for batch in batches:
        for table in _unpacked(batch):
            waiting.append(table)
            rows += table.num_rows
            if rows >= max(AT_ONCE, sums.num_rows if sums else 0):
                sums, waiting, rows = added(), [], 0
    if sums or waiting:
        total = added()
        total = total.filter(pc.greater_equal(total["n"], 2)).rename_columns(["term", "df"])
        yield from total.to_batches(ROWS_AT_ONCE)


@dataclass
class Frequencies:
    """of: term and df of the grams that two papers have at least; n_docs; the partitions that a shuffle of all grams is dealt to."""

    of: DataFrame
    n_docs: int
    parts: int


def frequencies(papers: DataFrame) -> Frequencies:
    """The papers that have each gram. Tasks sum up before the shuffle, and the shuffle has parts for the text's length, so a task's memory does not grow with the input."""
    size = papers.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("abstract").cast("long")), F.lit(0)).alias("chars")).first()
    parts = max(papers.sparkSession.sparkContext.defaultParallelism, -(-size.chars // PART_CHARS))
    some = _lowered(papers).select("texts").mapInArrow(_sums_of_papers(parts), _PACKED)
    of = stored(some.repartitionById(parts, F.col("part")).mapInArrow(_frequent, "term string, df long"))
    settle(of.sparkSession)
    return Frequencies(of, size.n, parts)


def document_frequency(f: Frequencies) -> DataFrame:
    """term and df of the grams in two papers at least and half of them at most."""
    return f.of.where(F.col("df") <= F.lit(f.n_docs * 0.5))


def _known(f: Frequencies, most: int) -> tuple[dict[str, int], int]:
    """df of the most frequent grams, `most` at most: all whose df is the second number or more."""
    steps = f.of.groupBy(F.floor(F.log2("df") * 4).alias("step")).agg(F.count(F.lit(1)).alias("terms"), F.min("df").alias("least"))
    least, terms = None, 0
    for s in steps.orderBy(F.desc("step")).collect():  # four for each doubling
        terms += s.terms
        if terms > most:
            break
        least = s.least
    if least is None:
        return {}, 2 if terms == 0 else 1 << 62
    rows = f.of.where(F.col("df") >= least).toArrow()  # `most` at most
    return dict(zip(rows["term"].to_pylist(), rows["df"].to_pylist(), strict=True)), 2 if terms <= most else least


def _rare(f: Frequencies, least: int) -> np.ndarray:
    """A bitmap with the hash of each gram in two papers at least whose df is below `least`: 16 bits for each, 2^SLOT_BITS at most."""
    rare = f.of.where(F.col("df") < least)
    bits = min(SLOT_BITS, max(15, (16 * rare.count()).bit_length()))
    slot = F.xxhash64("term").bitwiseAND(F.lit((1 << bits) - 1)) + 1  # bit positions are counted from 1
    pieces = rare.select(F.bitmap_bucket_number(slot).alias("piece"), F.bitmap_bit_position(slot).alias("at")).groupBy("piece").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in pieces.toLocalIterator():  # 4 kB each
        start = (row.piece - 1) * len(row.bits)
        out[start : start + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return out


_CANDIDATES = "source_id string, term string, c long, total long, df long"


def candidates(papers: DataFrame, f: Frequencies, top: int, most: int = KNOWN) -> DataFrame:
    """source_id, term, c (times), total (grams of the paper) and df of all grams that can be among the `top` of each paper; df is null where it has to be looked up.

    The frequent grams' df goes to all tasks. A rarer gram can be left out if it would be worse than `top` frequent ones even in two papers only, and if
    the bitmap of the grams of two papers says that it is in one only.
    """
    known, least = _known(f, most)
    weights = {df: log(f.n_docs / df) if df <= f.n_docs * 0.5 else 0.0 for df in set(known.values())}  # no gram of a result has weight 0
    of_weight = {w: df for df, w in weights.items()}
    shipped = papers.sparkSession.sparkContext.broadcast(({term: weights[df] for term, df in known.items()}, of_weight, _rare(f, least).tobytes() if least > 2 else b"\0"))
    hope = log(f.n_docs / 2) if least > 2 and f.n_docs >= 4 else 0.0

    def best(texts: list[str], weight_of: dict, of_weight: dict, rare: bytes) -> tuple[list, int]:
        """Terms with their times and df, and the grams of a paper."""
        grams = _grams(texts, Counter())
        total, mask = grams.total(), 8 * len(rare) - 1
        highest = nlargest(top, [c * w for term, c in grams.items() if (w := weight_of.get(term))])
        # scores are rounded to twelve digits later
        bound = highest[-1] - 1e-11 * total if len(highest) == top else -inf
        most = max(hope, max(of_weight, default=0.0))
        scored, looked_up = [], []
        for term, c in grams.items():
            if c * most >= bound:
                w = weight_of.get(term)
                if w:
                    if c * w >= bound:
                        scored.append((c * w, term, c, of_weight[w]))
                elif w is None and hope and c * hope >= bound:
                    slot = xxh64_intdigest(term, 42) & mask
                    if rare[slot >> 3] >> (slot & 7) & 1:
                        looked_up.append((term, c, None))
        ties = Counter()
        for _, term, c, df in sorted(scored, reverse=True):  # of grams with one score the largest are first
            ties[c, df] += 1
            if ties[c, df] <= top:
                looked_up.append((term, c, df))
        return looked_up, total

    def run(batches):
        for batch in batches:
            rows = []
            for source, texts in zip(batch.column("source_id"), batch.column("texts"), strict=True):
                found, total = best(texts.as_py(), *shipped.value)
                s = source.as_py()
                rows += [(s, term, c, total, df) for term, c, df in found]
                if len(rows) >= ROWS_AT_ONCE:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return _lowered(papers).mapInArrow(run, _CANDIDATES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["source_id", "term", "c", "total", "df"])


def _dealt(df: DataFrame, parts: int, key: str) -> DataFrame:
    """df by a key in as many partitions, if Spark would make fewer."""
    return df.repartition(parts, key) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def concepts(papers: DataFrame, top: int = 12, most: int = KNOWN) -> DataFrame:
    """source_id, rank, term, score: the grams of each paper with the highest TF-IDF."""
    f = frequencies(papers)
    found = stored(candidates(papers, f, top, most))
    rare = _dealt(found.where("df is null").drop("df"), f.parts, "term").join(_dealt(document_frequency(f), f.parts, "term").hint("shuffle_hash"), "term")
    both = found.where("df is not null").unionByName(rare)
    score = F.round(F.col("c") / F.col("total") * F.log(F.lit(f.n_docs) / F.col("df")), 12)
    scored = _dealt(both.select("source_id", "term", score.alias("score")), f.parts, "source_id")
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), F.desc("term")))
    best = stored(scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top))
    dropped(found, f.of)
    settle(best.sparkSession)
    return best


def edges(papers: DataFrame, found: DataFrame) -> DataFrame:
    """src, relation, dst: a paper's authors, categories and concepts, once each."""
    author = papers.select("source_id", F.lit("AUTHORED_BY").alias("relation"), F.explode("authors").alias("x")).select("source_id", "relation", F.concat(F.lit("author:"), "x").alias("dst"))
    category = papers.select("source_id", F.lit("IN_CATEGORY").alias("relation"), F.explode("categories").alias("x")).select("source_id", "relation", F.concat(F.lit("category:"), "x").alias("dst"))
    mentions = found.select("source_id", F.lit("MENTIONS").alias("relation"), F.concat(F.lit("concept:"), "term").alias("dst"))
    return author.unionByName(category).unionByName(mentions).where("dst is not null").distinct().withColumnRenamed("source_id", "src")


def stats(papers: DataFrame, e: DataFrame) -> DataFrame:
    kinds = e.select("dst").distinct().agg(*[F.count_if(F.col("dst").startswith(f"{k}:")).alias(n) for k, n in (("author", "authors"), ("category", "categories"), ("concept", "concepts"))])
    one = kinds.crossJoin(papers.agg(F.countDistinct("source_id").alias("papers"))).crossJoin(e.agg(F.count(F.lit(1)).alias("edges")))
    return one.select((F.col("papers") + F.col("authors") + F.col("categories") + F.col("concepts")).alias("nodes"), "papers", "authors", "categories", "concepts", "edges")


@dataclass
class Links:
    """Edges made ready for relatedness: near (src, relation, dst, n, gain) of nodes that several papers have; and of each paper its hubs as a signature."""

    near: DataFrame
    signed: DataFrame  # src, sig
    meant: DataFrame  # sig, relation, dst
    first: DataFrame  # sig, other: the papers of a signature with the smallest ids
    hub: int
    most: int


def linked(e: DataFrame, hub: int = HUB, most: int = MOST) -> Links:
    """A node of more than `hub` papers is a hub. Papers with the same hubs have one signature, of which the `most` + 1 smallest ids are kept."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in EDGE_WEIGHTS.items() for x in kv])[F.col("relation")], F.lit(0.5))
    degree = e.groupBy("relation", "dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    near = stored(e.join(degree, ["relation", "dst"]).select("src", "relation", "dst", "n", (weight / F.log(F.col("n") + F.lit(1.5))).alias("gain")))
    nodes_of = near.where(F.col("n") > hub).groupBy("src").agg(F.array_sort(F.collect_set(F.struct("relation", "dst"))).alias("nodes"))
    signed = stored(nodes_of.select("src", F.md5(F.to_json("nodes")).alias("sig"), "nodes"))
    meant = stored(signed.groupBy("sig").agg(F.any_value("nodes").alias("nodes")).select("sig", F.inline("nodes")))
    place = F.row_number().over(Window.partitionBy("sig").orderBy("src"))
    first = stored(signed.withColumn("place", place).where(F.col("place") <= most + 1).select("sig", F.col("src").alias("other")))
    return Links(near, signed.select("src", "sig"), meant, first, hub, most)


def related(seeds: DataFrame, links: Links, limit: int = 5) -> DataFrame:
    """src, other, relatedness, rank: the papers that share most neighbours with each seed (src).

    Papers that share a node of few papers with a seed are listed through it. Of papers that share hubs alone, those with one signature are
    equally related, so only the first of them by id can be among the best: a seed meets a few ids for each signature and not the papers of a hub. Those of them that
    share other nodes too are listed already, and are more related than the rest of their signature. Signatures are met through the hubs that `met` names only.
    """
    if limit > links.most:
        raise ValueError(f"at most {links.most} related papers are kept ready")
    mine = links.near.join(seeds.select("src").distinct(), "src", "left_semi")
    few = links.near.where(F.col("n") <= links.hub).select("relation", "dst", F.col("src").alias("other"))
    listed = stored(mine.where(F.col("n") <= links.hub).join(few, ["relation", "dst"]).where("src <> other").groupBy("src", "other").agg(F.sum("gain").alias("own")))
    hubs = stored(mine.where(F.col("n") > links.hub))
    sig_of_other = links.signed.withColumnRenamed("src", "other")
    through = hubs.join(met(hubs, listed, limit), ["src", "relation", "dst"], "left_semi").join(links.meant, ["relation", "dst"]).select("src", "sig")
    pairs = through.unionByName(listed.join(sig_of_other, "other").select("src", "sig")).distinct()
    common = stored(pairs.join(links.meant, "sig").join(hubs, ["src", "relation", "dst"]).groupBy("src", "sig").agg(F.sum("gain").alias("common")))
    one = listed.join(sig_of_other, "other", "left").join(common, ["src", "sig"], "left").select("src", "other", (F.col("own") + F.coalesce("common", F.lit(0.0))).alias("total"))
    two = common.join(links.first, "sig").where("src <> other").join(listed, ["src", "other"], "left_anti").select("src", "other", F.col("common").alias("total"))
    scores = one.unionByName(two).select("src", "other", F.round("total", 6).alias("relatedness"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("relatedness"), "other"))
    return scores.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit)


def met(hubs: DataFrame, listed: DataFrame, limit: int) -> DataFrame:
    """src, relation, dst: the hubs through which a seed has to meet others.

    A seed has `limit` others that are related by some number at least: those of a hub by its gain, and those listed by what they share. The largest hubs whose
    gains add up to less than that are left out, since who shares nothing else with the seed comes after these others.
    """
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("own"), "other"))
    sure = listed.withColumn("place", place).where(F.col("place") == limit).select("src", F.col("own").alias("sure"))
    largest = F.max(F.when(F.col("n") > limit, F.col("gain"))).over(Window.partitionBy("src"))
    sums = F.sum("gain").over(Window.partitionBy("src").orderBy(F.desc("n"), "relation", "dst").rowsBetween(Window.unboundedPreceding, 0))
    told = hubs.withColumns({"largest": largest, "sums": sums}).join(sure, "src", "left")
    least = F.coalesce(F.greatest("largest", "sure"), F.lit(0.0)) - F.lit(2e-6)  # relatedness has six digits
    return told.where(F.col("sums") >= least).select("src", "relation", "dst")


def seed_papers(seeds: DataFrame, considered: int = 3) -> DataFrame:
    """qid and src of the first papers of ranked seeds (qid, source_id, rank)."""
    first = seeds.groupBy("qid", "source_id").agg(F.min("rank").alias("first"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("first"))
    return first.withColumn("place", place).where(F.col("place") <= considered).select("qid", F.col("source_id").alias("src"))


def neighbour_chunks(pool: DataFrame, questions: DataFrame, chunks: DataFrame, links: Links, weight: float, candidates: int = 20, neighbours: int = 3) -> tuple[DataFrame, DataFrame]:
    """The hybrid seeds of each question, and the best chunks of papers related to the first of them, with their score and the paper's share of the largest relatedness."""
    seeds = retrieval.ranked(retrieval.blend(pool, weight), candidates)
    starts = seed_papers(seeds)
    found = starts.join(related(starts, links, neighbours), "src").select("qid", F.col("other").alias("source_id"), "relatedness")
    fresh = found.join(seeds.select("qid", "source_id"), ["qid", "source_id"], "left_anti").groupBy("qid", "source_id").agg(F.max("relatedness").alias("relatedness"))
    share = F.coalesce(F.col("relatedness") / F.nullif(F.max("relatedness").over(Window.partitionBy("qid")), F.lit(0.0)), F.lit(0.0))
    fresh = stored(fresh.withColumn("share", share))  # then Spark knows how few they are, and does not shuffle the chunks
    q = questions.select("qid", F.col("v").alias("qv"), F.col("norm2").alias("qn"))
    near = chunks.select("source_id", "chunk_index", "v", "norm2").join(fresh, "source_id").join(q, "qid")
    scored = near.select("qid", "source_id", "chunk_index", "share", retrieval.cosine(T.dot("qv", "v"), F.col("qn"), F.col("norm2")).alias("sim"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "source_id", "chunk_index"))
    near = retrieval.overlap(scored.withColumn("place", place).where(F.col("place") <= candidates), questions, chunks)
    return seeds, retrieval.blend(near, weight).select("qid", "source_id", "chunk_index", "score", "share")


def merged(seeds: DataFrame, near: DataFrame, graph_weight, top: int = 5, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The best of seeds and of neighbours' chunks, whose score is discounted by graph_weight and share; each chunk once, seeds first on ties."""
    g = graph_weight if not isinstance(graph_weight, (int, float)) else F.lit(float(graph_weight))
    boosted = near.select(*by, "source_id", "chunk_index", (F.col("score") * ((F.lit(1.0) - g) + g * F.col("share"))).alias("score"), F.lit(1).alias("origin"))
    both = seeds.select(*by, "source_id", "chunk_index", "score", F.lit(0).alias("origin")).unionByName(boosted)
    order = [F.desc("score"), "origin", "source_id", "chunk_index"]
    once = both.withColumn("nth", F.row_number().over(Window.partitionBy(*by, "source_id", "chunk_index").orderBy(*order))).where("nth = 1")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return once.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select(*by, "rank", "source_id", "chunk_index", F.round("score", 4).alias("score"))


def expanded(pool: DataFrame, questions: DataFrame, chunks: DataFrame, links: Links | None, weight: float, graph_weight: float, top: int = 5, candidates: int = 20, neighbours: int = 3) -> DataFrame:
    """Hybrid search whose seeds bring in chunks of related papers; pool has sim and kw, chunks are embedded. A graph_weight of 0 needs no links."""
    if graph_weight <= 0:
        return retrieval.hybrid(pool, weight, top)
    return merged(*neighbour_chunks(pool, questions, chunks, links, weight, candidates, neighbours), graph_weight, top)


def nodes(papers: DataFrame, e: DataFrame) -> DataFrame:
    """id and type of all papers and of what they are linked with."""
    linked = e.select(F.col("dst").alias("id"), F.element_at(F.split("dst", ":"), 1).alias("type"))
    return papers.select(F.col("source_id").alias("id"), F.lit("paper").alias("type")).unionByName(linked).distinct()

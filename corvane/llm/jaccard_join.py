"""N-gram Jaccard self-join by token-combination prefixes, and the components of its links.

A document is the set of its distinct shingles (hashed to 64 bits). All shingles have one order: rare ones first, by
counts over all documents in a table of fixed size, then by hash. Equal sets become one class at once. If two different
sets reach the threshold, their prefixes, extended by k - 1, share at least k shingles (or all that the
threshold asks for, if fewer). A class indexes the rare shingles of its extended prefix alone and, of the frequent ones,
pairs: not all of them, but those within one of g(n) groups by hash, so that a set of n shingles has a number of
pairs in proportion to n. f shared frequent shingles show as f - g shared pairs at least, and k exceeds g by SHARED, so
two sets that link have SHARED keys in common (or all but one that the threshold asks for, if fewer).

Classes that share index keys are candidates, after a bound on their sizes. They are verified on
their whole sets in two rounds: neighbours in each key's list, and every entry of a list with those that share
the largest part of their keys, one of each size; then, against the components so far, every pair that still spans two of them.
Pairs within one component could not change it; no other pair is left out.

Edited copies of one text share most of their keys whether they link or not. So classes that share many keys with the same
entries are one family, and the entry that most of them share keys with is its hub. A pair of one family is not
looked up by its keys but by its differences from the hub: the shingles that only one of the two sets has. If two sets
link and do not both link with the hub, they must share several of these. So a prefix of them, rare ones
first, is enough, and a key counts only where enough differences follow it. This holds for any hub. Pairs of two families are
looked up by their keys. The sets of the classes that have candidates are written once, for all rounds.

Documents with fewer words than a shingle have their whole sequence as the only one; without words
(null, empty) they have no set and link with nothing. Rows with the same doc_id are one document
that has the links of all of them; a null doc_id counts as the smallest id. Very long texts have as many keys as others in
proportion to their length. An empty table gives no rows. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Filter, Words, as_bytes, explode, mix, quoted, schema, slices, stored
from corvane.llm.components import connected_components

SHINGLE, PERCENT = 4, 85
#: Counters of shingles, as a power of 2, and how many of them travel together.
COUNTER_BITS, BLOCK = 22, 4_096
#: Index keys that two linked sets have in common at least.
SHARED = 12
#: A shingle is frequent if its counter has more than this, and more than twice the mean.
FREQUENT = 3_000
NULL_ID = -(2**63)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row, repeats included, ASCII letters lower-cased, and the bounds of each text's."""
    words = Words(texts)
    w, counts = words.hashes, np.diff(words.bounds)
    times = np.where(counts, np.maximum(counts - size + 1, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(times)])
    at = np.arange(bounds[-1]) + np.repeat(words.bounds[:-1] - bounds[:-1], times)
    length = np.repeat(np.minimum(counts, size), times)
    h = np.zeros(len(at), np.uint64)
    for j in range(size):
        if len(inside := np.flatnonzero(length > j)) == len(at):
            h = mix(h + w[at + j] + np.uint64(j + 1))
        else:
            h[inside] = mix(h[inside] + w[at[inside] + j] + np.uint64(j + 1))
    return h + length.astype(np.uint64), bounds


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted, once each."""
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def _counter_of(h: np.ndarray) -> np.ndarray:
    return ((h * _ODD) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


class Ranks:
    """How common shingles are: a step of a logarithmic scale for each counter."""

    STEPS = 4

    def __init__(self, table: np.ndarray, mean: float, frequent: int = FREQUENT) -> None:
        self.table = table
        self.often = int(self.step(max(frequent, 2 * mean)))

    @classmethod
    def step(cls, counts):
        return np.ceil(cls.STEPS * np.log2(counts + 1.0)).astype(np.uint8)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        return self.table[_counter_of(h)]

    def sorted(self, h: np.ndarray) -> np.ndarray:
        """Rare ones first."""
        return h[np.lexsort((h, self(h)))]


def shingle_ranks(docs: DataFrame, size: int, frequent: int = FREQUENT) -> Ranks:
    """Counts of the shingles of all documents (doc, text), in a table of fixed size."""
    width = np.uint16(BLOCK)

    def count(batches):
        total = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                np.add.at(total, _counter_of(shingles(as_bytes(piece.column("text")), size)[0]), np.uint32(1))
        blocks = total.reshape(-1, width)
        seen = np.flatnonzero(blocks.any(axis=1))
        small = blocks.max(axis=1) < 256
        raw = [(blocks[k].astype(np.uint8) if small[k] else blocks[k]).tobytes() for k in seen]
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw, pa.binary())], names=["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums.setdefault(block, np.zeros(BLOCK, np.int64))
                sums[block] += np.frombuffer(raw, np.uint8 if len(raw) == BLOCK else np.uint32)
        columns = [pa.array(list(sums), pa.int32()), pa.array([Ranks.step(x).tobytes() for x in sums.values()], pa.binary()), pa.array([int(x.sum()) for x in sums.values()], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "steps", "total"])

    table, total = np.zeros((1 << COUNTER_BITS) // BLOCK * BLOCK, np.uint8).reshape(-1, BLOCK), 0
    for r in docs.select("text").mapInArrow(count, schema("block int, counts binary")).repartition("block").mapInArrow(add, schema("block int, steps binary, total long")).collect():  # fixed size
        table[r.block] = np.frombuffer(r.steps, np.uint8)
        total += r.total
    return Ranks(table.ravel(), total / table.size, frequent)


def needed(n, percent: int):
    """The least overlap that a set of n shingles has with any set that it links with."""
    return -(-percent * n // 100)


def groups(n: int) -> int:
    """How many groups the frequent shingles of a set of n are dealt to; a power of 2."""
    return 1 << max(0, (n // 32).bit_length() - 1)


def index_keys(s: np.ndarray, ranks: Ranks, percent: int) -> np.ndarray:
    """Keys of a set: its rare shingles within the extended prefix, and pairs of frequent ones there. The last bit tells pairs."""
    n, one = len(s), np.uint64(1)
    if n < 2:
        return s[:0]
    spread = 1 << int(np.ceil(np.log2(100 / percent)))  # a linked set has at most so many times the groups
    r = ranks(s)
    prefix = n - needed(n, percent) + SHARED + spread * groups(n)
    if prefix < n:
        at = np.argpartition((r.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)), prefix - 1)[:prefix]
        s, r = s[at], r[at]
    often = r >= ranks.often
    f = np.sort(s[often])
    group = mix(f) & np.uint64(groups(n) - 1)
    order = np.argsort(group, kind="stable")
    f, group = f[order], group[order]
    begin = np.searchsorted(group, group, side="left")
    times = np.arange(len(f)) - begin
    j = np.repeat(np.arange(len(f)), times)
    i = np.arange(len(j)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin, times)
    return np.concatenate([s[~often] & ~one, mix(mix(f[i]) + f[j] * np.uint64(3)) | one])


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").reshape(-1, 2).astype(np.int64)


def keyed_sets(docs: DataFrame, ranks: Ranks, size: int, percent: int) -> DataFrame:
    """doc, n, h1, h2 (hash of the set) and keys of every document of docs (doc, text)."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)  # fixed size

    def make():
        ranks = shipped.value

        def step(piece):
            h, bounds = shingles(as_bytes(piece.column("text")), size)
            sets = [distinct(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            found = _digests(sets)
            keys = [index_keys(s, ranks, percent).tobytes() for s in sets]
            return [piece.column("doc"), pa.array([len(s) for s in sets], pa.int64()), pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(keys, pa.binary())]

        return step

    return explode(docs, "text", make, schema("doc long, n long, h1 long, h2 long, keys binary"), 1 << 20)


def _mixed(doc: np.ndarray) -> np.ndarray:
    return mix(mix(doc.view(np.uint64)))


def live_sets(docs: DataFrame, live: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """doc and the whole set (items) of the classes whose doc is in live; texts are not shuffled."""

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_mixed(np.asarray(batch.column("doc"))).view(np.int64))], names=["key"])

    shipped = docs.sparkSession.sparkContext.broadcast(Filter(live.select("doc").mapInArrow(keys, schema("key long"))))  # bounded

    def make():
        may = shipped.value

        def step(piece):
            wanted = pa.array(may(_mixed(np.asarray(piece.column("doc")))))
            some = piece.filter(wanted)
            if not some.num_rows:
                return None
            h, bounds = shingles(as_bytes(some.column("text")), size)
            sets = [distinct(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            found = _digests(sets)
            return [some.column("doc"), pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array([s.tobytes() for s in sets], pa.binary())]

        return step

    found = explode(docs, "text", make, schema("doc long, h1 long, h2 long, items binary"), 1 << 20)
    wanted = classes.join(live.select("doc"), "doc", "left_semi").select("doc", "h1", "h2")
    return found.join(wanted, ["doc", "h1", "h2"], "left_semi").dropDuplicates(["doc", "h1", "h2"])


def _listed(classes: DataFrame, carried: list[str], *order) -> DataFrame:
    """key and the carried long columns of every class and key, sorted by key and then as asked for."""

    def run(batches):
        for whole in batches:
            for cut in range(0, whole.num_rows, 2_000):
                batch = whole.slice(cut, 2_000)
                keys = batch.column("keys").to_pylist()
                times = np.array([len(k) // 8 for k in keys], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(keys), np.int64))] + [pa.array(np.repeat(np.asarray(batch.column(c)), times)) for c in carried], names=["key", *carried])

    out = classes.select(*carried, "keys").mapInArrow(run, schema("key long, " + ", ".join(f"{c} long" for c in carried)))
    return out.repartition("key").sortWithinPartitions("key", *order)


class _Pairs:
    """Pairs of documents with the single and the combined keys that they have in common, summed now and then."""

    def __init__(self, directed: bool = False) -> None:
        self.parts, self.size, self.directed = [], 0, directed

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, key: np.ndarray, alone: np.ndarray | None = None) -> bool:
        """n: size of the larger set. Whether it is time to take the pairs."""
        if len(a):
            alone = np.zeros(len(a), bool) if alone is None else alone
            self.parts.append((a if self.directed else np.minimum(a, b), b if self.directed else np.maximum(a, b), n, key & 1, alone))
            self.size += len(a)
        return self.size > 1_000_000

    def take(self) -> pa.RecordBatch:
        a, b, n, combined, alone = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order = np.lexsort((b, a))
        a, b, n, combined, alone = a[order], b[order], n[order], combined[order], alone[order]
        begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        times, pairs = np.diff(np.append(begin, len(a))), np.add.reduceat(combined, begin)
        columns = (a[begin], b[begin], n[begin], times - pairs, pairs, np.add.reduceat(alone.astype(np.int64), begin))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "n", "single", "paired", "alone"])


_COUNTED = "a long, b long, n long, single long, paired long, alone long"


def _summed(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.max("n").alias("n"), *(F.sum(c).alias(c) for c in ("single", "paired", "alone")))


def _enough(percent: int, part: int = 1) -> Column:
    """Whether the keys in common allow for a link, or are that many parts of it."""
    least = F.greatest(F.least(F.lit(SHARED), F.ceil(F.col("n") * percent / 100) - 1), F.lit(1))
    return F.col("single") + F.col("paired") >= least / part


def _neighbours(batches, percent: int):
    """Pairs of each list's neighbours that fit in size, the smaller first.

    alone counts the keys in whose lists the first of a pair has no such neighbour before it. So an entry's keys with a
    neighbour are those of its pairs as the second, and alone of its pairs as the first.
    """
    pairs = _Pairs(directed=True)
    last, counted = None, False
    for whole in batches:
        for cut in range(0, whole.num_rows, 200_000):
            batch = whole.slice(cut, 200_000)
            key, doc, n = (np.asarray(batch.column(c)) for c in ("key", "doc", "n"))
            if last is not None:
                key, doc, n = (np.concatenate([[x], y]) for x, y in zip(last, (key, doc, n), strict=True))
            same = (key[1:] == key[:-1]) & (100 * n[:-1] >= percent * n[1:])
            before = np.concatenate([[counted], same])
            full = pairs.add(doc[:-1][same], doc[1:][same], n[1:][same], key[1:][same], ~before[:-1][same])
            last, counted = (key[-1], doc[-1], n[-1]), before[-1]
            if full:
                yield pairs.take()
    if pairs.size:
        yield pairs.take()


def _stars(batches, percent: int):
    """Pairs of each list's leaders (a) with later entries (b) that fit in size. An entry that fits with no leader before it is one.

    Leaders do not fit with each other. So an entry has a few at most, and a first entry of another size leaves none without.
    """
    pairs = _Pairs(directed=True)
    leaders = None
    for whole in batches:
        for cut in range(0, whole.num_rows, 200_000):
            batch = whole.slice(cut, 200_000)
            columns = [np.asarray(batch.column(c)) for c in ("key", "doc", "n")]
            if leaders is not None:
                columns = [np.concatenate(x) for x in zip(leaders, columns, strict=True)]
            key, doc, n = columns
            if not len(key):
                continue
            place = np.arange(len(key))
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
            led, last = np.zeros(len(key), bool), []
            while not led.all():
                lists, at = np.unique(of[~led], return_index=True)
                leader = np.full(len(begin), len(key))
                leader[lists] = place[~led][at]
                led[leader[lists]] = True
                if lists[-1] == len(begin) - 1:
                    last.append(leader[-1])
                later = np.flatnonzero(place > leader[of])
                first = leader[of[later]]
                most = np.maximum(n[later], n[first])
                fits = 100 * np.minimum(n[later], n[first]) >= percent * most
                led[later[fits]] = True
                fits &= doc[later] != doc[first]
                if pairs.add(doc[first[fits]], doc[later[fits]], most[fits], key[later[fits]]):
                    yield pairs.take()
            leaders = [c[last] for c in columns]
    if pairs.size:
        yield pairs.take()


def _by_list(batches, columns: tuple[str, ...], pick):
    """Pairs that pick(pairs, *columns) yields for each list that holds entries of several components."""
    pairs, held = _Pairs(), []
    which = columns.index("comp")

    def ended():
        """The list that is held, in one piece."""
        found = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        if found[which].min() != found[which].max():
            yield from pick(pairs, *found)

    for whole in batches:
        for cut in range(0, whole.num_rows, 200_000):
            batch = whole.slice(cut, 200_000)
            found = [np.asarray(batch.column(c)) for c in columns]
            key, comp = found[0], found[which]
            if held and held[-1][0][-1] != key[0]:
                yield from ended()
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(begin[1:], len(key))
            if held and len(begin) > 1:  # the list that is held ends in this batch
                held.append([c[: ends[0]] for c in found])
                yield from ended()
                begin, ends = begin[1:], ends[1:]
            mixed = np.minimum.reduceat(comp, begin) != np.maximum.reduceat(comp, begin)
            for k in np.flatnonzero(mixed[:-1]):
                yield from pick(pairs, *(c[begin[k] : ends[k]] for c in found))
            held.append([c[begin[-1] :] for c in found])
    if held:
        yield from ended()
    if pairs.size:
        yield pairs.take()


def _spanning(batches, percent: int):
    """Pairs of a list's entries that lie in different components, have different hubs and fit in size."""

    def pick(pairs, key, doc, n, comp, hub):
        if hub.min() == hub.max():
            return
        stop = np.searchsorted(n, 100 * n // percent, side="right")
        for i in range(len(doc) - 1):
            far = np.flatnonzero((comp[i + 1 : stop[i]] != comp[i]) & (hub[i + 1 : stop[i]] != hub[i])) + i + 1
            if pairs.add(np.full(len(far), doc[i]), doc[far], n[far], key[far]):
                yield pairs.take()

    return _by_list(batches, ("key", "doc", "n", "comp", "hub"), pick)


def _least_common(n, percent: int):
    """The least overlap of two sets that link, from the sum of their sizes."""
    return -(-percent * n // (100 + percent))


def _apart_at_most(both, percent: int):
    """The largest symmetric difference of two sets that link, from the sum of their sizes."""
    return both - 2 * _least_common(both, percent)


def _least_shared(n: int, apart: int, hub_n: int, linked: bool, percent: int) -> int:
    """The least number of differences from the hub that a set shares with any other that it could newly join.

    One of the two at least does not link with the hub, or they are in one component by it. So it is never below 1.
    """
    other = np.arange(-(-percent * n // 100), 100 * n // percent + 1)
    most = _apart_at_most(n + other, percent)
    least = np.maximum(np.abs(other - hub_n), apart - most)
    if linked:
        least = np.maximum(least, _apart_at_most(other + hub_n, percent) + 2)
    return max(1, int(np.min(-((most - apart - least) // 2))))


def _residual(batches, percent: int):
    """Pairs of a list's entries that lie in different components and do not both link with the hub.

    rest counts the differences from the key on. If it is the first one that two sets share, they share no more than that.
    """

    def pick(pairs, key, doc, n, comp, linked, apart, rest):
        stop = np.searchsorted(n, 100 * n // percent, side="right")
        for i in range(len(doc) - 1):
            at = np.flatnonzero((comp[i + 1 : stop[i]] != comp[i]) & (linked[i + 1 : stop[i]] + linked[i] < 2)) + i + 1
            at = at[2 * np.minimum(rest[at], rest[i]) >= apart[at] + apart[i] - _apart_at_most(n[at] + n[i], percent)]
            if pairs.add(np.full(len(at), doc[i]), doc[at], n[at], np.full(len(at), key[0])):
                yield pairs.take()

    return _by_list(batches, ("key", "doc", "n", "comp", "linked", "apart", "rest"), pick)


def _differences(hubs: DataFrame, sets: DataFrame, ranks: Ranks, percent: int) -> DataFrame:
    """doc, hub, n, linked (1 if it links with the hub), apart and keys of each row of hubs (doc, hub).

    apart is the number of shingles that only one of the two sets has. They have one order for all sets of a hub: added
    ones, then removed ones, each by rarity. The keys stand for the hub and the first of them: as many as hold one of
    those that any set shares that this one could newly join.
    """
    shipped = sets.sparkSession.sparkContext.broadcast(ranks)  # fixed size
    both = hubs.join(sets.select("doc", F.col("items").alias("x")), "doc").join(sets.select(F.col("doc").alias("hub"), F.col("items").alias("y")), "hub").select("doc", "hub", "x", "y")

    def run(batches):
        ranks = shipped.value
        for whole in batches:
            for cut in range(0, whole.num_rows, 500):
                batch = whole.slice(cut, 500)
                out = []
                for hub, x, y in zip(batch.column("hub").to_pylist(), batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    added, removed = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                    differ = np.concatenate([ranks.sorted(added), ranks.sorted(removed)])
                    linked = 100 * (len(x) - len(added)) >= percent * (len(x) + len(removed))
                    indexed = len(differ) + 1 - _least_shared(len(x), len(differ), len(y), linked, percent)
                    salt = mix(np.array([hub], np.int64).view(np.uint64))
                    out.append((len(x), int(linked), len(differ), mix(differ[: max(0, indexed)] + salt).view(np.int64)))
                n, linked, apart, keys = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("hub"), *(pa.array(c, pa.int64()) for c in (n, linked, apart)), pa.array(keys, pa.list_(pa.int64()))], names=["doc", "hub", "n", "linked", "apart", "keys"])

    return both.mapInArrow(run, schema("doc long, hub long, n long, linked long, apart long, keys array<long>"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the threshold."""
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("doc").alias("b"), F.col("items").alias("y")), "b")

    def run(batches):
        for whole in batches:
            for cut in range(0, whole.num_rows, 500):
                batch = whole.slice(cut, 500)
                keep = []
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                    joined = np.sort(np.frombuffer(x + y, np.uint64), kind="stable")
                    common = int(np.count_nonzero(joined[1:] == joined[:-1]))
                    keep.append(100 * common >= percent * (len(joined) - common))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, schema("a long, b long"))


def _family_hubs(stars: DataFrame, classes: DataFrame) -> DataFrame:
    """doc and hub of the classes that share many keys with others: the entry of their family that most share keys with."""
    single = classes.groupBy("doc").agg(F.count(F.lit(1)).alias("sets")).where("sets = 1").select("doc")
    plain = stars.join(single.withColumnRenamed("doc", "a"), "a", "left_semi").join(single.withColumnRenamed("doc", "b"), "b", "left_semi")
    family = stored(connected_components(plain.select("a", "b")).toDF("doc", "family"))
    followers = plain.groupBy("a").agg(F.count(F.lit(1)).alias("f")).withColumnRenamed("a", "doc")
    leaders = family.join(followers, "doc").groupBy("family").agg(F.max_by("doc", F.struct("f", -F.col("doc"))).alias("hub"))
    return family.join(leaders, "family").select("doc", "hub")


def link_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """doc (null ids as the smallest long), n_shingles and component_id of each row; frequent: the least count of a shingle that is indexed in pairs."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    rows = docs.select(F.coalesce(F.col(quoted(doc_id)).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(quoted(text)).alias("text"))
    ranks = shingle_ranks(rows, size, frequent)
    keyed = stored(keyed_sets(rows, ranks, size, percent))
    members = keyed.select("doc", "n", "h1", "h2")
    classes = stored(keyed.where("n > 0").groupBy("h1", "h2").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("keys").alias("keys")))

    listed = _listed(classes, ["doc", "n"], "n", "doc")
    near = stored(_summed(listed.mapInArrow(lambda b: _neighbours(b, percent), schema(_COUNTED))))
    seen = near.select(F.col("b").alias("doc"), (F.col("single") + F.col("paired")).alias("single")).unionByName(near.select(F.col("a").alias("doc"), F.col("alone").alias("single")))
    sizes = classes.groupBy("doc").agg(F.min("n").alias("n"))
    live = seen.groupBy("doc").agg(F.sum("single").alias("single")).withColumn("paired", F.lit(0)).join(sizes, "doc").where(_enough(percent))
    live = stored(live.select("doc", F.col("single").alias("keys_shared")))
    sets = stored(live_sets(rows, live, classes, size).select("doc", "items"))
    classes = stored(classes.join(live, "doc").withColumn("live", F.floor(F.lit(1000) * F.col("keys_shared") / F.greatest(F.octet_length("keys") / 8, F.lit(1)))).drop("keys_shared"))
    reps = keyed.where("n > 0").groupBy("h1", "h2").agg(F.min("doc").alias("rep"))

    first = near.where("a <> b").where(_enough(percent, 2)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # the original of a group of edited copies shares the largest part of its keys and is likely to link with all of them
    starred = _listed(classes, ["doc", "n", "live"], F.desc("live"), "doc").mapInArrow(lambda b: _stars(b, percent), schema(_COUNTED))
    stars = stored(_summed(starred).where(_enough(percent, 4)))
    heads = stars.where(_enough(percent, 2)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried = stored(first.unionByName(heads).distinct())
    links = stored(_verified(tried, sets, percent))
    labels = stored(classes.join(connected_components(links).toDF("doc", "comp"), "doc", "left").select("doc", "n", "keys", F.coalesce("comp", "doc").alias("comp")))

    hubs = stored(_family_hubs(stars, classes))
    split = hubs.join(labels.select("doc", "comp"), "doc").groupBy("hub").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("hub")
    apart = stored(_differences(hubs.join(split, "hub"), sets, ranks, percent))
    links = links.unionByName(apart.where("linked = 1 and doc <> hub").select(F.col("doc").alias("a"), F.col("hub").alias("b")))

    places = labels.select("doc", "n", "comp", "keys").join(hubs, "doc", "left").withColumn("hub", F.coalesce("hub", "doc"))
    spanning = _summed(_listed(places, ["doc", "n", "comp", "hub"], "n", "doc").mapInArrow(lambda b: _spanning(b, percent), schema(_COUNTED))).where(_enough(percent)).select("a", "b")
    numbered = apart.join(labels.select("doc", "comp"), "doc").select("doc", "n", "comp", "linked", "apart", F.posexplode("keys").alias("place", "key"))
    around = numbered.select("key", "doc", "n", "comp", "linked", "apart", (F.col("apart") - F.col("place")).alias("rest"))
    residual = around.repartition("key").sortWithinPartitions("key", "n", "doc").mapInArrow(lambda b: _residual(b, percent), schema(_COUNTED)).select("a", "b")
    more = stored(_verified(stored(spanning.unionByName(residual).distinct().join(tried, ["a", "b"], "left_anti")), sets, percent))
    same = members.where("n > 0").join(reps, ["h1", "h2"])
    repeated = keyed.groupBy("doc").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc")
    shared = same.join(repeated, "doc").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    final = connected_components(links.unionByName(more).unionByName(shared)).select(F.col("node").alias("rep"), "component")
    named = same.join(final, "rep", "left").select("doc", "n", F.coalesce("component", "rep").alias("component_id"))
    alone = members.where("n = 0").select("doc", "n", F.col("doc").alias("component_id"))
    return named.unionByName(alone).withColumnRenamed("n", "n_shingles")


def join_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of each row of docs."""
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c if c != "doc" else "doc_id")
    return link_components(docs, doc_id, text, size, percent, frequent).select(null("doc"), "n_shingles", null("component_id"))

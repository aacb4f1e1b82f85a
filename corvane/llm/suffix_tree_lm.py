"""Language-model scores from a probabilistic suffix tree over words.

Tokens are lower-cased words and one end. The root of the tree predicts by add-one unigram
probabilities (their sum over a text is the base score). A context is one to `depth` words before a
token; texts begin after a start symbol. All training documents are counted, length by length: every context
and every pair of a context with a next word that occurs `least_count` times is a candidate, at any size, so
the tree grows with the corpus. A context stays if its next-word distribution diverges from that of its longest
shorter suffix: count * KL divergence >= `least_gain` nats. Distributions are smoothed: kept counts are
discounted, and the mass that this frees goes to all other words in proportion to the suffix's distribution.
A token is predicted in the state of the longest suffix that the tree has; the score is the sum of the log10
probabilities.

The tree is a table, never gathered. A pair is the n-gram of its context and next word, and what one n-gram
adds to the log probability of a text does not depend on the rest (see `_longer`), so a text's score is a sum over
a join of its n-grams with the table. Three things of fixed size only save work, without any effect on the result: executors
hold the counts of the `frequent` most frequent words, the values of the `cached` most frequent n-grams, and filters that tell most n-grams that
are not in a table. All other words and n-grams are joined with the full tables.

Null and empty texts are one end. Repeated rows score alike; each row counts in training; a null `train` does not learn. Very long texts are
read whole, one at a time. Words and n-grams are compared by 64-bit hashes. Without training rows, counts are 0 and every token has
probability 1. An empty table gives an empty one. Other columns are kept, or those asked for; one with the name of a result, in any case, is
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import Filter, Words, as_bytes, drop_stored, map_arrow, others, quoted, released, schema, settle, slices, stored

DEPTH, LEAST_COUNT, LEAST_GAIN, DISCOUNT = 3, 3, 2.0, 0.6
FREQUENT, CACHED = 500_000, 1_000_000
#: Stand for the end and the start in place of a word's hash.
END_TOKEN, START_TOKEN = np.uint64(0x5EED0E4D), np.uint64(0x5EED57A7)
#: Sums that a worker holds, bytes of text at once, n-grams that a part of a table of counts has about, and one of the tree (16 bytes each).
FLUSH, TEXT_BYTES, PART_GRAMS, TREE_PART = 250_000, 1 << 20, 1 << 19, 1 << 21


def tokens_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each after a start and before an end; where texts begin, and the total; whether it is a start."""
    words = Words(texts)
    n = np.diff(words.bounds)
    first = words.bounds[:-1] + 2 * np.arange(len(n))
    out, inner = np.empty(len(words.hashes) + 2 * len(n), np.uint64), np.ones(len(words.hashes) + 2 * len(n), bool)
    inner[first] = inner[first + n + 1] = False
    out[first], out[first + n + 1], out[inner] = START_TOKEN, END_TOKEN, words.hashes
    starts = np.zeros(len(out), bool)
    starts[first] = True
    return out, np.append(first, len(out)), starts


class Lookup:
    """Places of integer keys in a list, by open addressing."""

    def __init__(self, keys: np.ndarray) -> None:
        self.mask = (1 << max(4, int(2 * len(keys)).bit_length())) - 1
        self.keys, self.places = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left])
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]
            mine = self.keys[slot] == keys[left]
            self.places[slot[mine]] = left[mine]
            left = left[~mine]
            self.probes += 1
        self.probes = max(self.probes, 1)

    def _slot(self, keys: np.ndarray, probe: int | None = None) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(24)).astype(np.int64) + (self.probes if probe is None else probe)) & self.mask

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """-1 where a key is not in the list; no key is -1."""
        slot = self._slot(keys, 0)
        at = self.keys[slot]
        out = np.where(at == keys, self.places[slot], -1).astype(np.int64)
        left = np.flatnonzero((at != keys) & (at != -1))
        for probe in range(1, self.probes):
            if not len(left):
                break
            slot = self._slot(keys[left], probe)
            at = self.keys[slot]
            hit = at == keys[left]
            out[left[hit]] = self.places[slot[hit]]
            left = left[~hit & (at != -1)]
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """key and n of all tokens of the training rows of docs (text, train)."""

    def batch_of(held):
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, back = np.unique(keys, return_inverse=True)
        return keys, np.bincount(back, n, len(keys)).astype(np.int64)

    def run(batches):
        held, size = [], 0
        for texts in _training(batches):
            hashes, _, starts = tokens_of(texts)
            held.append(np.unique(hashes[~starts], return_counts=True))
            size += len(held[-1][0])
            if size > 6 * FLUSH:
                held = [batch_of(held)]
                size = len(held[0][0])
                if size > 3 * FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["key", "n"])
                    held, size = [], 0
        if size:
            keys, n = batch_of(held)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    return docs.mapInArrow(released(run), schema("key long, n long")).groupBy("key").agg(F.sum("n").alias("n"))


def _training(batches):
    """Lists of the texts of training rows."""
    for batch in batches:
        for piece in slices(batch, "text", TEXT_BYTES):
            if texts := as_bytes(piece.column("text").filter(piece.column("train"))):
                yield texts


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 where they are not in it."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def joined(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Key of the n-gram of its first and its last n - 1 words; the key of a single word is its hash."""
    h = prefix * np.uint64(0x9E3779B97F4A7C15) + suffix
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def grams(hashes: np.ndarray, starts: np.ndarray, longest: int):
    """For n from 1 to longest: keys of the n-grams that end at each token, and whether they lie in one text."""
    keys, inside = hashes, np.ones(len(hashes), bool)
    yield keys, inside
    for _ in range(1, longest):
        keys = np.concatenate([keys[:1], joined(keys[:-1], keys[1:])])
        inside = np.concatenate([[False], inside[:-1]])[: len(hashes)] & ~starts
        yield keys, inside


def _summed(prefix: np.ndarray, suffix: np.ndarray, n: np.ndarray | None = None):
    """key, prefix, suffix and count of the distinct n-grams, by key."""
    key = joined(prefix, suffix)
    order = np.argsort(key)
    key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(begin, len(key))) if n is None else np.add.reduceat(n[order], begin) if len(key) else n
    at = order[begin]
    return key[begin], prefix[at], suffix[at], times.astype(np.int64)


def _gram_counts(docs: DataFrame, shorter: Filter, size: int, tokens: int, least_count: int) -> DataFrame:
    """key, prefix, suffix and n of the n-grams of this size that occur least_count times, of which both shorter parts may be in the table.

    Counts travel as packed arrays, in parts by key; no row is made for an n-gram before its count is known.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(shorter)
    bits = max(1, int(tokens // PART_GRAMS).bit_length())

    def packed(prefix, suffix):
        key, prefix, suffix, n = _summed(prefix, suffix)
        part = (key >> np.uint64(64 - bits)).astype(np.int64)
        at, begin = np.unique(part, return_index=True)
        small = n.max(initial=0) < 256
        n = n.astype(np.uint8 if small else np.uint32)
        ends = np.append(begin[1:], len(part))
        blobs = [prefix[a:b].tobytes() + suffix[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(begin, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(ends - begin), pa.array(blobs, pa.binary())], names=["part", "n", "grams"])

    def count(batches):
        may, held, size_held = shipped.value, [], 0
        for texts in _training(batches):
            hashes, _, starts = tokens_of(texts)
            *_, (before, inside) = grams(hashes, starts, size - 1)
            passed = may(before)
            at = np.flatnonzero(inside[:-1] & ~starts[1:] & passed[1:] & passed[:-1]) + 1
            held.append((before[at - 1], before[at]))
            size_held += len(at)
            if size_held > 4 * FLUSH:
                yield packed(*map(np.concatenate, zip(*held, strict=True)))
                held, size_held = [], 0
        if size_held:
            yield packed(*map(np.concatenate, zip(*held, strict=True)))

    def total(blobs):
        parts = []
        for n, raw in blobs:
            prefix, suffix = np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint64, n, 8 * n)
            parts.append((prefix, suffix, np.frombuffer(raw, np.uint8 if len(raw) == 17 * n else np.uint32, n, 16 * n).astype(np.int64)))
        found = _summed(*map(np.concatenate, zip(*parts, strict=True)))
        often = found[-1] >= least_count
        return pa.RecordBatch.from_arrays([pa.array(x[often].view(np.int64)) for x in found], names=["key", "prefix", "suffix", "n"])

    def merge(batches):
        last, held = None, []
        for batch in batches:
            for part, n, raw in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), batch.column("grams"), strict=True):
                raw = raw.as_py()
                if part != last and held:
                    yield total(held)
                    held = []
                last = part
                held.append((n, raw))
        if held:
            yield total(held)

    parts = docs.mapInArrow(released(count), schema("part long, n long, grams binary")).repartition("part").sortWithinPartitions("part")
    return parts.mapInArrow(released(merge), schema("key long, prefix long, suffix long, n long"))


def _longer(docs: DataFrame, shorter: DataFrame, size: int, tokens: int, least_count: int, least_gain: float) -> DataFrame:
    """The n-grams of one size more than shorter's, with what their contexts add if they stay.

    Rows have key, prefix, n, log_p (log10 probability of the last word in the state of the words before, if
    the longest context is theirs), value, context_n, and back_off in one row of each context that stays. An n-gram's value is log_p less that of its suffix and
    less the back-off factor of its context; a context's is its back-off factor. Then the values of all n-grams that
    end in a token and of all contexts before it add up to its log10 probability less that of the root: those of
    shorter n-grams cancel out, and the factors stay of contexts too long for the token. (An n-gram's suffix
    has its count at least, so it is in the table too.)
    """
    counts = _gram_counts(docs, Filter(shorter), size, tokens, least_count)
    prefixes = shorter.select(F.col("key").alias("prefix"), F.col("n").alias("context_n"))
    suffixes = shorter.select(F.col("key").alias("suffix"), F.col("log_p").alias("log_q"))
    found = counts.join(suffixes, "suffix").join(prefixes, "prefix")
    by_context = Window.partitionBy("prefix")
    p, q = (F.col("n") - DISCOUNT) / F.col("context_n"), F.pow(F.lit(10.0), "log_q")
    found = found.withColumns({"mass": F.sum(p).over(by_context), "above": F.sum(q).over(by_context), "kl": F.sum(p * F.log(p / q)).over(by_context), "first": F.min("key").over(by_context)})
    rest, rest_above = (1 - F.least(F.col(c), F.lit(1 - 1e-6)) for c in ("mass", "above"))
    stays = F.col("context_n") * (F.col("kl") + rest * F.log(rest / rest_above)) >= least_gain
    back_off = F.log10(rest / rest_above)
    log_p = F.when(stays, F.log10(p)).otherwise(F.col("log_q"))
    value = F.when(stays, F.log10(p) - F.col("log_q") - back_off).otherwise(F.lit(0.0))
    return stored(found.select("key", "prefix", "n", "context_n", log_p.alias("log_p"), value.alias("value"), F.when(stays & (F.col("key") == F.col("first")), back_off).alias("back_off")))


def fit_tree(docs: DataFrame, words: DataFrame, divisor: float, tokens: int, depth: int = DEPTH, least_count: int = LEAST_COUNT, least_gain: float = LEAST_GAIN) -> DataFrame:
    """key, value and n of all n-grams of the tree. docs: text and train; words: key and n of all training tokens."""
    start = words.where(F.col("key") == int(END_TOKEN)).select(F.lit(int(START_TOKEN)).alias("key"), "n")
    log_p = F.log10((F.col("n") + 1) / divisor)
    grown = stored(words.unionByName(start).where(F.col("n") >= least_count).select("key", "n", log_p.alias("log_p")))
    out, levels = None, [grown]
    for size in range(2, depth + 2):
        grown = _longer(docs, grown, size, tokens, least_count, least_gain)
        levels.append(grown)
        settle(docs.sparkSession)  # the shuffle files of this size go
        contexts = grown.where("back_off is not null").select(F.col("prefix").alias("key"), F.col("back_off").alias("value"), F.col("context_n").alias("n"))
        both = contexts.unionByName(grown.where("value <> 0").select("key", "value", "n"))
        out = both if out is None else out.unionByName(both)
    tree = stored(out.groupBy("key").agg(F.sum("value").alias("value"), F.max("n").alias("n")))
    drop_stored(*levels)
    return tree


def _bucket(n: str) -> Column:
    return F.floor(4 * F.log2(n))


def _most_frequent(tree: DataFrame, cached: int) -> int:
    """The least bucket of counts so that those from it on have at most so many n-grams."""
    sizes = dict(tree.groupBy(_bucket("n").alias("b")).count().collect())
    least = max(sizes, default=0) + 1
    for b in sorted(sizes, reverse=True):
        cached -= sizes[b]
        if cached < 0:
            break
        least = b
    return least


def _key_part(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _sums_of_values(wanted: DataFrame, tree: DataFrame) -> DataFrame:
    """row and the sum of the values of its n-grams that the tree has. wanted: row, grams (packed keys); tree: key, value.

    Both sides travel as packed arrays in parts by key, so that no row is made for an occurrence.
    """
    bits = max(1, int(tree.count() // TREE_PART).bit_length())
    spec = schema("part long, side int, keys binary, beside binary")

    def batch_of(keys, beside, side):
        order = np.argsort(keys)
        keys, beside = keys[order], beside[order]
        parts, begin = np.unique(_key_part(keys, bits), return_index=True)
        ends = np.append(begin[1:], len(keys))
        blobs = [[x[a:b].tobytes() for a, b in zip(begin, ends, strict=True)] for x in (keys, beside)]
        return pa.RecordBatch.from_arrays([pa.array(parts), pa.array([side] * len(parts), pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], names=spec.names)

    def entries(batches):
        for batch in batches:
            yield batch_of(np.asarray(batch.column("key")).view(np.uint64), np.asarray(batch.column("value")), 0)

    def occurrences(batches):
        held, size = [], 0
        for batch in batches:
            for row, raw in zip(batch.column("row").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                held.append((row, raw))
                size += len(raw) // 8
                if size > 4 * FLUSH:
                    yield gathered(held)
                    held, size = [], 0
        if size:
            yield gathered(held)

    def gathered(held):
        times = [len(raw) // 8 for _, raw in held]
        return batch_of(np.frombuffer(b"".join(raw for _, raw in held), np.uint64), np.repeat(np.array([row for row, _ in held], np.int64), times), 1)

    def look_up(batches):
        part, sums, size = None, [], 0
        held, keys, values = [], np.zeros(0, np.uint64), np.zeros(0)

        def summed():
            rows, back = np.unique(np.concatenate([x for x, _ in sums]), return_inverse=True)
            return rows, np.bincount(back, np.concatenate([x for _, x in sums]), len(rows))

        for batch in batches:
            parts, sides = batch.column("part").to_pylist(), batch.column("side").to_pylist()
            for now, side, k, v in zip(parts, sides, batch.column("keys"), batch.column("beside"), strict=True):
                k, v = k.as_buffer(), v.as_buffer()  # no copies of the packed arrays
                if now != part:
                    part, held, keys, values = now, [], np.zeros(0, np.uint64), np.zeros(0)
                if side == 0:
                    held.append((np.array(np.frombuffer(k, np.uint64)), np.array(np.frombuffer(v, np.float64))))
                    continue
                if held:  # no copy lives longer than it must
                    keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
                    held = []
                    order = np.argsort(keys)
                    keys = keys[order]
                    values = values[order]
                    del order
                at = _find(keys, np.frombuffer(k, np.uint64))
                hit = at >= 0
                if hit.any():
                    rows, back = np.unique(np.frombuffer(v, np.int64)[hit], return_inverse=True)
                    sums.append((rows, np.bincount(back, values[at[hit]], len(rows))))
                    size += len(rows)
                if size > 4 * FLUSH:  # one sum of each row for all parts of the task, unless the rows are too many to hold
                    sums = [summed()]
                    size = len(sums[0][0])
                    if size > 2 * FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in sums[0]], names=["row", "value"])
                        sums, size = [], 0
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], names=["row", "value"])

    both = tree.select("key", "value").mapInArrow(entries, spec).unionByName(wanted.mapInArrow(released(occurrences), spec))
    met = both.repartition("part").sortWithinPartitions("part", "side").mapInArrow(released(look_up), schema("row long, value double"))
    return met.groupBy("row").agg(F.sum("value").alias("value"))


def score(docs: DataFrame, train: Column, text: str = "text", keep: list[str] | None = None, frequent: int = FREQUENT, cached: int = CACHED, depth: int = DEPTH, **options) -> DataFrame:
    """docs, or the columns of it to keep, with n_tokens, n_known, train_tokens, base_score and score; rows with train are learnt from."""
    learnt = docs.select(F.col(quoted(text)).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    words = stored(word_counts(learnt))
    total, distinct = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    total = total or 0
    divisor = float(total + distinct + 1)
    tree = fit_tree(learnt, words, divisor, total, depth, **options)
    often = words.where(_bucket("n") >= _most_frequent(words, frequent)).toArrow()
    known_words, times = often["key"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(known_words)
    least = _most_frequent(tree, cached)
    held = tree.where(_bucket("n") >= least).select("key", "value").toArrow()
    joins = tree.where(_bucket("n") < least).select("key", "value")
    shipped = docs.sparkSession.sparkContext.broadcast((known_words[order], np.log10((times[order] + 1) / divisor), held["key"].to_numpy(), held["value"].to_numpy(), Filter(joins)))
    kept = others(docs if keep is None else docs.select(*map(quoted, keep)), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    source = docs.select(*kept, F.col(quoted(text)).alias("__text"))
    out = source.drop("__text").schema
    for part in schema("__n_tokens long, __known long, __base double, __gain double, __rare array<long>, __times array<long>, __grams binary"):
        out.add(part)

    def lists(keys, doc, texts):
        edges = np.searchsorted(doc, np.arange(texts + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(edges), pa.array(keys))

    def run(batches):
        frequent, log_base, keys, values, may = shipped.value
        place_of, lookup = Lookup(frequent.view(np.int64)), Lookup(keys)
        for batch in batches:
            for piece in slices(batch, "__text", TEXT_BYTES):
                hashes, bounds, starts = tokens_of(as_bytes(piece.column("__text")))
                place, real = place_of(hashes.view(np.int64)), ~starts
                hit = (place >= 0) & real
                base, gain = np.where(hit, log_base[place] if len(log_base) else 0.0, 0.0), np.zeros(len(hashes))
                first, texts = bounds[:-1], len(bounds) - 1
                doc = np.repeat(np.arange(texts), np.diff(bounds))
                rest, docs_of = [], []
                for key, inside in grams(hashes, starts, depth + 1):
                    at = lookup(key.view(np.int64))
                    in_cache = inside & (at >= 0)
                    gain[in_cache] += values[at[in_cache]]
                    left = np.flatnonzero(inside & (at < 0) & may(key))
                    rest.append(key[left])
                    docs_of.append(doc[left])
                rest, docs_of = np.concatenate(rest), np.concatenate(docs_of)
                rest = rest[np.argsort(docs_of, kind="stable")]
                edges = np.concatenate([[0], np.cumsum(np.bincount(docs_of, minlength=texts))]).tolist()
                packed = pa.array([rest[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
                sums = [np.add.reduceat(x, first) for x in (real.astype(np.int64), hit.astype(np.int64), base, gain)]
                rare = np.flatnonzero(real & ~hit)
                rare = rare[np.lexsort((hashes[rare], doc[rare]))]
                begin = np.flatnonzero(np.concatenate([[True], (hashes[rare[1:]] != hashes[rare[:-1]]) | (doc[rare[1:]] != doc[rare[:-1]])])) if len(rare) else rare
                times, of = np.diff(np.append(begin, len(rare))), doc[rare[begin]]
                arrays = [lists(hashes[rare[begin]].view(np.int64), of, texts), lists(times, of, texts), packed]
                yield pa.RecordBatch.from_arrays([piece.column(i) for i in range(len(kept))] + [pa.array(x) for x in sums] + arrays, names=out.names)

    scored = stored(map_arrow(source, run, out).withColumn("__row", F.monotonically_increasing_id()))
    rare = scored.select("__row", F.explode(F.arrays_zip("__rare", "__times")).alias("x")).select("__row", F.col("x.__rare").alias("key"), F.col("x.__times").alias("t"))
    counted = rare.join(words, "key", "left").select("__row", "t", F.coalesce("n", F.lit(0)).alias("n"))
    sums = stored(counted.groupBy("__row").agg(F.sum(F.when(F.col("n") > 0, F.col("t")).otherwise(0)).alias("__more"), F.sum(F.col("t") * F.log10((F.col("n") + 1) / F.lit(divisor))).alias("__rest")))
    gains = stored(_sums_of_values(scored.select(F.col("__row").alias("row"), F.col("__grams").alias("grams")), joins).toDF("__row", "__other"))
    joined_all = scored.drop("__rare", "__times", "__grams").join(sums, "__row", "left").join(gains, "__row", "left")
    base = F.col("__base") + F.coalesce("__rest", F.lit(0.0))
    return joined_all.select(*kept, F.col("__n_tokens").alias("n_tokens"), (F.col("__known") + F.coalesce("__more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("__gain") + F.coalesce("__other", F.lit(0.0))).alias("score"))

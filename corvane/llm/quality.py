"""Quality classifier: supervised subword embeddings.

A word's vector is the mean of the hashed vectors of the word and of its character n-grams (with
bounds); a document's is the mean of its words' vectors plus the mean of its hashed word-pair
vectors, and a softmax layer gives the classes. A pair of equal words hashes to one shared bucket,
so that repetition itself can be learnt. Training is stochastic gradient descent (steps scaled by
past gradients) in numpy in one task, for EPOCHS passes over the whole texts of a bounded sample: the `rows` labelled
rows with the smallest hash of their id; texts over LONG characters are taken only if there are not enough others. Scores
use whole texts and nothing but text; a long text is scored in pieces of PIECE characters, whose sums are added, with the same result.

Null and empty texts have the vector 0 and get the score that the bias gives. Repeated rows score
alike; ties in the sample's order go to the smaller id and text. A run without white space of over PIECE characters counts
as several words. Rows without a label, or with a label other than 0 and 1, do not train; without any training
row every score is 0.5. An empty table gives no rows. Other columns are kept, except those named score or predicted in
any case, which are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import append, quoted, released

SAMPLE_ROWS, LONG, EPOCHS = 1_000, 100_000, 8
BUCKET_BITS, DIM, GRAMS = 17, 8, (2, 3, 4)
#: Characters of a text scored at once, and bytes of texts.
PIECE, SCORED_BYTES = 1 << 18, 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MULT = np.uint64(0x100000001B3)
_WHITE = re.compile(r"\s")


def _bucket(hashes: np.ndarray, salt: int) -> np.ndarray:
    mixed = (hashes ^ np.uint64(salt * 0x5851F42D4C957F2D & (2**64 - 1))) * _ODD
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * _MULT) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of some words, the bounds of each word's features, and a hash of each word."""
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    codes = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), lengths)
    place = (np.arange(begin[-1]) - begin[owner]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    spread = codes * _ODD
    spread ^= spread >> np.uint64(31)
    hashes = np.add.reduceat(spread * (place * _MULT), begin[:-1])
    buckets, owners = [_bucket(hashes, 1)], [np.arange(len(words))]
    rolling = spread.copy()
    for n in range(2, max(GRAMS) + 1):
        rolling = rolling[:-1] * _MULT + spread[n - 1 :]
        if n in GRAMS and len(rolling):
            inside = owner[: len(rolling)] == owner[n - 1 :]
            buckets.append(_bucket(rolling[inside], n))
            owners.append(owner[: len(rolling)][inside])
    everyone = np.concatenate(owners)
    order = np.argsort(everyone, kind="stable")
    return np.concatenate(buckets)[order], np.concatenate([[0], np.cumsum(np.bincount(everyone, minlength=len(words)))]), hashes


def _pair_buckets(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    pairs = hashes[a] * _MULT + hashes[b]
    pairs[a == b] = 0
    return _bucket(pairs, 99)


class Batch:
    """Training texts as numbers of the table's rows that they touch: features of each distinct word, and pairs of neighbours."""

    def __init__(self, texts: list[str], labels: np.ndarray) -> None:
        number: dict[str, int] = {}
        ids = [[number.setdefault(w, len(number)) for w in t.split()] for t in texts]
        self.n, self.labels = len(texts), labels
        self.ids = np.array([i for x in ids for i in x], np.int32)
        self.doc = np.repeat(np.arange(self.n, dtype=np.int32), [len(x) for x in ids])
        features, edges, hashes = subwords(list(number)) if number else (np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.uint64))
        self.owner = np.repeat(np.arange(len(number), dtype=np.int32), np.diff(edges))
        inside = self.doc[1:] == self.doc[:-1]
        pairs = _pair_buckets(hashes, self.ids[:-1][inside], self.ids[1:][inside])
        self.pair_doc = self.doc[1:][inside]
        self.rows, local = np.unique(np.concatenate([features, pairs]), return_inverse=True)
        self.features, self.pairs = local[: len(features)].astype(np.int32), local[len(features) :].astype(np.int32)
        self.words = np.maximum(np.bincount(self.doc, minlength=self.n), 1)
        self.n_pairs = np.maximum(np.bincount(self.pair_doc, minlength=self.n), 1)
        self.width = np.maximum(np.diff(edges), 1)

    def vectors(self, table: np.ndarray) -> np.ndarray:
        """table: its rows that are touched."""
        out = np.empty((self.n, table.shape[1]))
        for d in range(table.shape[1]):
            word = np.bincount(self.owner, table[self.features, d], len(self.width)) / self.width
            out[:, d] = np.bincount(self.doc, word[self.ids], self.n) / self.words + np.bincount(self.pair_doc, table[self.pairs, d], self.n) / self.n_pairs
        return out

    def loss_and_gradients(self, table: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Mean cross entropy, and its gradients by the touched rows, the weights and the bias."""
        v = self.vectors(table)
        p = _softmax(v @ weights + bias)
        loss = -np.log(p[np.arange(self.n), self.labels]).mean()
        p[np.arange(self.n), self.labels] -= 1
        p /= self.n
        grad = p @ weights.T
        by_word, by_pair = grad / self.words[:, None], grad / self.n_pairs[:, None]
        out = np.empty(table.shape)
        for d in range(table.shape[1]):
            word = np.bincount(self.ids, by_word[self.doc, d], len(self.width)) / self.width
            out[:, d] = np.bincount(self.features, word[self.owner], len(table)) + np.bincount(self.pairs, by_pair[self.pair_doc, d], len(table))
        return loss, out, v.T @ p, p.sum(axis=0)


class Model:
    def __init__(self, table: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        self.table, self.weights, self.bias = table.astype(np.float32), weights, bias


class _Words(dict):
    """Vectors and hashes of words as they come; forgets everything when it is full."""

    LIMIT = 100_000

    def __init__(self, table: np.ndarray) -> None:
        super().__init__()
        self.table = table
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.vectors, self.hashes = np.zeros((0, self.table.shape[1]), np.float32), np.zeros(0, np.uint64)

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        self.fresh.append(word)
        return i

    def numbers(self, words: list[str]) -> np.ndarray:
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        for at in range(0, len(self.fresh), 20_000):
            features, edges, hashes = subwords(self.fresh[at : at + 20_000])
            sums = np.add.reduceat(self.table[features], edges[:-1], axis=0) / np.diff(edges)[:, None]
            self.vectors, self.hashes = np.concatenate([self.vectors, sums.astype(np.float32)]), np.concatenate([self.hashes, hashes])
        self.fresh = []
        return ids


def _pieces(text: str, size: int):
    """A text cut at white space into pieces of about size characters."""
    at = 0
    while len(text) - at > size:
        found = _WHITE.search(text, at + size, at + 2 * size)
        if not found and len(text) - at <= 2 * size:
            break
        stop = found.start() if found else at + size
        yield text[at:stop]
        at = stop
    yield text[at:]


class Scorer:
    def __init__(self, model: Model, piece: int = PIECE) -> None:
        self.model, self.known, self.piece = model, _Words(model.table), piece

    def _sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums of the word vectors and of the pair vectors of each text, and how many of each."""
        if len(self.known) > self.known.LIMIT:
            self.known.forget()
        words = [t.split() for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        ids = self.known.numbers([w for x in words for w in x])
        doc = np.repeat(np.arange(len(texts)), sizes)
        inside = np.flatnonzero(doc[1:] == doc[:-1])
        pairs = _pair_buckets(self.known.hashes, ids[inside], ids[inside + 1])
        n_pairs = np.maximum(sizes - 1, 0)
        return self._added(self.known.vectors[ids], sizes), sizes, self._added(self.model.table[pairs], n_pairs), n_pairs

    @staticmethod
    def _added(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out, some = np.zeros((len(sizes), rows.shape[1])), sizes > 0
        if some.any():
            out[some] = np.add.reduceat(rows, (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.float64)
        return out

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """Probability of class 1."""
        parts, owner, counted = [], [], []
        for k, t in enumerate(texts):
            before = None
            for part in _pieces(t or "", self.piece):
                if before is not None:  # the pair that the cut has parted; its words are in the pieces
                    last, first = before.split()[-1:], part.split(None, 1)[:1]
                    parts.append(" ".join(last + first))
                    owner.append(k)
                    counted.append(0)
                parts.append(part)
                owner.append(k)
                counted.append(1)
                before = part
        words, pairs = np.zeros((len(texts), self.model.table.shape[1])), np.zeros((len(texts), self.model.table.shape[1]))
        n_words, n_pairs = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        sizes = np.cumsum([len(p) for p in parts]) // (2 * self.piece)
        for at in (np.flatnonzero(sizes == s) for s in np.unique(sizes)):
            word, n, pair, m = self._sums([parts[i] for i in at])
            to, whole = np.array(owner)[at], np.array(counted)[at]
            np.add.at(words, to, word * whole[:, None])
            np.add.at(n_words, to, n * whole)
            np.add.at(pairs, to, pair)
            np.add.at(n_pairs, to, m)
        v = words / np.maximum(n_words, 1)[:, None] + pairs / np.maximum(n_pairs, 1)[:, None]
        return _softmax(v @ self.model.weights + self.model.bias)[:, 1]


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, batch: int = 16, rate: float = 0.2, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    weights, bias = rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    seen, seen_w, seen_b = np.full(table.shape, 1e-6, np.float32), np.full(weights.shape, 1e-2), np.full(2, 1e-2)
    y = np.array(labels, np.int64)
    order = rng.permutation(len(y))
    batches = [Batch([texts[i] for i in order[k : k + batch]], y[order[k : k + batch]]) for k in range(0, len(y), batch)]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(batches)):
            b = batches[k]
            _, g_table, g_w, g_b = b.loss_and_gradients(table[b.rows], weights, bias)
            past = seen[b.rows] + g_table * g_table
            seen[b.rows] = past
            table[b.rows] -= step * g_table / np.sqrt(past)
            for value, grad, past in ((weights, g_w, seen_w), (bias, g_b, seen_b)):
                past += grad * grad
                value -= step * grad / np.sqrt(past)
    return Model(table, weights, bias)


def fit(docs: DataFrame, labels: DataFrame, train_on: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Train on at most `rows` labelled documents that train_on (over doc_id) selects; an id with several labels has the smallest."""
    marked = labels.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(label)).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    marked = marked.groupBy("id").agg(F.min("y").alias("y"))
    usable = docs.where(train_on & F.col(quoted(text)).isNotNull()).select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("t"))
    order = [F.length("t") > LONG, F.xxhash64("id"), F.col("id").cast("string"), F.xxhash64("t")]
    keyed = usable.select("id", *(c.alias(f"o{k}") for k, c in enumerate(order)))
    picked = keyed.join(marked, "id").orderBy(*(f"o{k}" for k in range(len(order)))).limit(rows)
    chosen = picked.select("id", "y", "o3").distinct()
    found = usable.withColumn("o3", F.xxhash64("t")).join(F.broadcast(chosen), ["id", "o3"])  # at most `rows` ids
    sample = found.orderBy(F.xxhash64("id"), F.col("id").cast("string"), "t").limit(rows).select("t", "y")  # rows may be repeated

    def run(batches):
        texts, marks = [], []
        for batch in batches:
            texts += batch.column("t").to_pylist()
            marks += batch.column("y").to_pylist()
        if texts:
            model = train(texts, marks)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (model.table, model.weights, model.bias)], names=["table", "weights", "bias"])

    made = sample.mapInArrow(released(run), "table binary, weights binary, bias binary").collect()
    if not made:
        return Model(np.zeros((1 << BUCKET_BITS, DIM)), np.zeros((DIM, 2)), np.zeros(2))
    return Model(np.frombuffer(made[0].table, np.float32).reshape(-1, DIM), np.frombuffer(made[0].weights).reshape(DIM, 2), np.frombuffer(made[0].bias))


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (probability of label 1) and predicted (1 if the score is 0.5 or more)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed

    def make():
        scorer = Scorer(shipped.value)

        def step(piece):
            s = scorer(piece.column(text).to_pylist())
            return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

        return step

    return append(docs, text, make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], SCORED_BYTES)

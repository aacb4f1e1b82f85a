"""A Merkle manifest of a dataset: a tree of digests for each group of rows, and one tree over the groups.

H is the sha256 of its inputs, concatenated; digests go in as hexadecimal text. A leaf is H of the row's fields, each `-` if
null, else the length in UTF-8 bytes, `:` and the value. The leaves of a group ascend by key (then by their digest); while there are several
nodes, every `ARITY` neighbours become their H, the last run being shorter if need be. A group's last node is its subroot (a lone leaf is its own);
the subroots, ordered by group (null first, then by UTF-8 bytes), make the root in the same way.

Nodes are built by events. An event is a digest that has become known; it goes to the partial parent of its key
(tree, level, place), which keeps the digests of the children it has seen, each at its place. The number of leaves of a tree says how many
children a parent has; once it has them all, its digest is the next event, in the same task. Leaves come range partitioned, so all but the
parents at the borders of partitions are whole after one pass; the partial ones (a few for each border and level) are shuffled by their
key, put together and go on, until none is left.

Proofs follow the links back from a node to its parent. Leaves are dealt in blocks of ARITY ** BLOCK_LEVELS neighbours; a block gets the nodes
below its top, the ancestors of its top, and those of its subroot. So no task holds a group, and a block is bounded.

Null keys come first; null groups are one group. Repeated rows are leaves each, in places next to each other. Texts are hashed whole, by Spark's own
functions. An empty table has no leaves and no root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import quoted, released, schema, stored
from corvane.llm.ordered import numbered

ARITY_BITS = 4
ARITY = 1 << ARITY_BITS
BLOCK_LEVELS = 3
#: Partial parents that a task holds at once; beyond, they go to the next round as they are.
OPEN = 50_000
#: Rows or proofs put into one batch.
BATCH_ROWS, BATCH_BYTES = 20_000, 8 << 20
NODE = "tree string, level int, at long, n long, have int, children binary, digest binary"


def digest_of(children: bytes) -> bytes:
    return hashlib.sha256(children.hex().encode()).digest()


def nodes_on(n: int, level: int) -> int:
    """Nodes on a level of a tree with so many leaves."""
    return max(1, -(-n >> (ARITY_BITS * level)))


def encoded(fields: list[Column]) -> Column:
    """The fields of a leaf as one binary value."""
    one = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
    return F.concat(*map(one, fields)).cast("binary")


def leaf_digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(encoded(fields), 256))


_ARROW = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("have", pa.int32()), ("children", pa.binary()), ("digest", pa.binary())])


def combined(have: int, children: bytes, more: int, others: bytes) -> tuple[int, bytes]:
    """Both bitmaps and the digests of both, by place; a child that both have counts once."""
    if more < (have & -have):  # all of the others come before
        return have | more, others + children
    places = {}
    for bits, packed in ((more, others), (have, children)):
        k = 0
        while bits:
            low = bits & -bits
            places[low] = packed[k : k + 32]
            bits, k = bits ^ low, k + 32
    return have | more, b"".join(places[low] for low in sorted(places))


class _Parents:
    """Partial parents by tree, level and place: a bitmap of the children seen, their digests by place, and the leaves of the tree."""

    def __init__(self) -> None:
        self.open: dict[tuple, tuple] = {}
        self.whole: list[tuple] = []

    def merge(self, tree, level: int, at: int, n: int, have: int, children: bytes) -> None:
        """Put a partial parent in; as long as one is whole, it becomes a node and a child of the next."""
        while True:
            key = (tree, level, at)
            if (held := self.open.pop(key, None)) is not None:
                have, children = combined(have, children, held[0], held[1])
            if have.bit_count() < min(ARITY, nodes_on(n, level - 1) - ARITY * at):
                self.open[key] = (have, children, n)
                return
            digest = digest_of(children)
            self.whole.append((tree, level, at, n, have, children, digest))
            if nodes_on(n, level) == 1:
                return
            level, at, have, children = level + 1, at >> ARITY_BITS, 1 << (at & (ARITY - 1)), digest

    def drain(self, partial: bool) -> pa.RecordBatch | None:
        """The nodes found since the last time, and the partial parents if wanted."""
        rows, self.whole = self.whole, []
        if partial:
            rows += [(tree, level, at, n, have, children, None) for (tree, level, at), (have, children, n) in self.open.items()]
            self.open = {}
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW) if rows else None


def _events(batches):
    """Parents that are whole, and those that stay partial in this task."""
    parents = _Parents()
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for row in zip(*columns, strict=True):
            parents.merge(*row)
            full = len(parents.open) > OPEN
            if (full or len(parents.whole) > BATCH_ROWS) and (out := parents.drain(full)) is not None:
                yield out
    if (out := parents.drain(True)) is not None:
        yield out


def grow(leaves: DataFrame) -> DataFrame:
    """The inner nodes of the trees whose leaves have tree, at, n and digest: tree, level (from 1), at, n, have, children (packed digests), digest."""
    bit = F.expr(f"shiftleft(1, cast(at & {ARITY - 1} as int))")
    first = leaves.where("n > 1").select("tree", F.lit(1).alias("level"), F.shiftright("at", ARITY_BITS).alias("at"), "n", bit.alias("have"), F.col("digest").alias("children"))
    found = stored(first.mapInArrow(released(_events), NODE))
    nodes, open_ends = found.where("digest is not null"), found.where("digest is null")
    while not open_ends.isEmpty():
        dealt = open_ends.drop("digest").repartition("tree", "level", "at").sortWithinPartitions("tree", "level", "at")
        found = stored(dealt.mapInArrow(released(_events), NODE))
        nodes, open_ends = nodes.unionByName(found.where("digest is not null")), found.where("digest is null")
    return nodes


def height(n: Column) -> Column:
    """Levels above the leaves of a tree with n leaves."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.floor((F.length(F.bin(n - 1)) + (ARITY_BITS - 1)) / ARITY_BITS).cast("int"))


@dataclass
class Manifest:
    """leaves: tree, key, leaf, at, n; nodes: those of all groups; heads: tree, at, n, digest of each subroot in order; top: nodes over the subroots; root: its digest, or None without rows."""

    leaves: DataFrame
    nodes: DataFrame
    heads: DataFrame
    top: DataFrame
    root: bytes | None


def roots(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """tree, digest of each tree's last node."""
    lone = leaves.where("n = 1").select("tree", "digest")
    return lone.unionByName(nodes.where(F.col("level") == height(F.col("n"))).select("tree", "digest"))


def manifest(rows: DataFrame, fields: list[Column], group: str, key: str, keep: dict[str, Column] | None = None) -> Manifest:
    """The trees of rows; fields make the leaves. keep: further columns of the leaves, by name."""
    leaves = stored(rows.select(F.col(quoted(group)).cast("string").alias("tree"), F.col(quoted(key)).alias("key"), leaf_digest(fields).alias("digest"), *(c.alias(name) for name, c in (keep or {}).items())))
    leaves = stored(numbered(leaves, ["tree"], [F.col("key").asc_nulls_first(), F.col("digest").asc()]).drop("row", "before").sortWithinPartitions("tree", "at"))
    nodes = grow(leaves)
    heads = roots(leaves, nodes).withColumn("all", F.lit(True))
    heads = stored(numbered(heads, ["all"], [F.col("tree").asc_nulls_first()]).drop("row", "before", "all").sortWithinPartitions("at"))
    over = heads.select(F.lit(None).cast("string").alias("tree"), "at", "n", "digest")
    top = grow(over)
    last = roots(over, top).first()
    return Manifest(leaves, nodes, heads, top, bytes(last["digest"]) if last else None)


_BITS = ARITY_BITS * BLOCK_LEVELS


def proofs(m: Manifest, keep: list[str] | None = None) -> DataFrame:
    """key, tree, digest, subroot and the proof of each leaf, and columns of the leaves to keep.

    proof has the siblings' digests, packed, level by level from the leaf's run to the root's, left to right; places and sizes say for each level which child of a
    run the node is, and of how many. A tree with one node on a level has no run there.
    """
    keep = keep or []
    block = F.shiftright("at", _BITS)
    # A row for a block is a node below its top (kind 0), an ancestor of the top (1), or of the subroot (2), or a leaf (3).
    blocks = m.leaves.where(F.col("at") % (1 << _BITS) == 0).select("tree", F.col("n").alias("leaves"), block.alias("block"))
    below = m.nodes.where(F.col("level") <= BLOCK_LEVELS).select("tree", F.expr(f"shiftright(at, {ARITY_BITS} * ({BLOCK_LEVELS} - level))").alias("block"), F.lit(0).alias("kind"), "level", "at", "children")
    levels = F.explode(F.sequence(F.lit(BLOCK_LEVELS + 1), height(F.col("leaves")))).alias("level")
    wanted = blocks.where(height(F.col("leaves")) > BLOCK_LEVELS).select("tree", "block", levels)
    wanted = wanted.withColumn("up", F.expr(f"shiftright(block, {ARITY_BITS} * (level - {BLOCK_LEVELS}))"))
    upper = m.nodes.where(F.col("level") > BLOCK_LEVELS).select(F.col("tree").alias("t"), F.col("level").alias("l"), "at", "children")
    above = wanted.join(upper, F.col("tree").eqNullSafe(F.col("t")) & (F.col("level") == F.col("l")) & (F.col("up") == F.col("at"))).select("tree", "block", F.lit(1).alias("kind"), "level", "at", "children")
    heads = m.heads.select(F.col("tree").alias("t"), F.col("at").alias("rank"), F.col("n").alias("groups"), F.col("digest").alias("subroot"))
    steps = heads.where("groups > 1").withColumn("level", F.explode(F.sequence(F.lit(1), height(F.col("groups")))))
    steps = steps.withColumn("up", F.expr(f"shiftright(rank, {ARITY_BITS} * level)")).withColumn("down", F.expr(f"shiftright(rank, {ARITY_BITS} * (level - 1))"))
    tops = m.top.select(F.col("level").alias("l"), "at", "children")
    steps = steps.join(tops, (F.col("level") == F.col("l")) & (F.col("up") == F.col("at"))).select("t", "level", F.col("down").alias("at"), "children")
    none = heads.select("t", F.lit(0).alias("level"), F.col("rank").alias("at"), F.col("subroot").alias("children"))
    over = blocks.join(steps.unionByName(none), F.col("tree").eqNullSafe(F.col("t"))).select("tree", "block", F.lit(2).alias("kind"), "level", "at", "children")
    spec = m.leaves.select("key", "tree", "digest", *map(quoted, keep)).schema
    for f in schema("subroot binary, proof binary, places array<int>, sizes array<int>"):
        spec.add(f)
    empty = [F.lit(None).cast(m.leaves.schema[c].dataType).alias(c) for c in keep]
    nothing = F.lit(None).cast(m.leaves.schema["key"].dataType).alias("key")
    links = below.unionByName(above).unionByName(over).select("tree", "block", "kind", "level", "at", F.col("children").alias("digest"), nothing, *empty)
    leaves = m.leaves.select("tree", block.alias("block"), F.lit(3).alias("kind"), F.lit(0).alias("level"), "at", "digest", "key", *map(quoted, keep))
    dealt = links.unionByName(leaves).repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "level", "at")

    def run(batches):
        now, links, chain, rest = None, {}, [], {}
        rows, proof, places, sizes, heads, size = [], [], [], [], [], 0

        def put(batch):
            taken = batch.take(pa.array(rows))
            columns = [taken.column("key"), taken.column("tree"), taken.column("digest"), *(taken.column(c) for c in keep)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(heads, pa.binary()), pa.array(proof, pa.binary()), pa.array(places, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))], names=spec.names)

        def upwards(at: int):
            """What all leaves of a level-1 parent share: the siblings from its own run to the root, and the places and sizes there."""
            siblings, where, of, level = [], [], [], 1
            runs = []
            while (level + 1, at >> ARITY_BITS) in links:
                runs.append((links[level + 1, at >> ARITY_BITS], at & (ARITY - 1)))
                level, at = level + 1, at >> ARITY_BITS
            for children, k in [*runs, *chain]:
                siblings.append(children[: 32 * k] + children[32 * k + 32 :])
                where.append(k)
                of.append(len(children) // 32)
            return b"".join(siblings), where, of

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("tree", "block", "kind", "level", "at", "digest")]
            for i, (tree, block, kind, level, at, digest) in enumerate(zip(*columns, strict=True)):
                if (tree, block) != now:
                    now, links, chain, rest, subroot = (tree, block), {}, [], {}, None
                if kind < 2:
                    links[level, at] = digest
                elif kind == 2 and level == 0:
                    subroot = digest
                elif kind == 2:
                    chain.append((digest, at & (ARITY - 1)))
                else:
                    up = at >> ARITY_BITS
                    if up not in rest:
                        rest = {up: upwards(up)}
                    siblings, where, of = rest[up]
                    children = links.get((1, up))
                    if children is not None:
                        k = at & (ARITY - 1)
                        siblings, where, of = children[: 32 * k] + children[32 * k + 32 :] + siblings, [k, *where], [len(children) // 32, *of]
                    rows.append(i)
                    heads.append(subroot)
                    proof.append(siblings)
                    places.append(where)
                    sizes.append(of)
                    size += len(siblings) + 256
                    if size > BATCH_BYTES:
                        yield put(batch)
                        rows, proof, places, sizes, heads, size = [], [], [], [], [], 0
            if rows:
                yield put(batch)
                rows, proof, places, sizes, heads, size = [], [], [], [], [], 0

    return dealt.mapInArrow(released(run), spec)


def folded(leaf: Column) -> Column:
    """The root that a leaf's digest and the proof (proof, places, sizes) beside it lead to."""

    def step(acc, run):
        place, siblings = run["places"], run["sizes"] - 1
        at = acc["at"]
        text = lambda start, n: F.lower(F.hex(F.substring(F.col("proof"), start, 32 * n)))
        whole = F.concat(text(at, place), F.lower(F.hex(acc["digest"])), text(at + 32 * place, siblings - place))
        return F.struct(F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"), (at + 32 * siblings).alias("at"))

    return F.aggregate(F.arrays_zip("places", "sizes"), F.struct(leaf.alias("digest"), F.lit(1).alias("at")), step)["digest"]

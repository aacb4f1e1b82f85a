"""Chat examples from trees of replies.

Messages have an id, the id of the message that they answer, a role, a text and perhaps a score. Every path from a root to a leaf is a
conversation; the paths of each root are ranked by the mean score of their messages, and the best become examples.

Paths are never listed to be ranked. Iterated self-joins first double the reach of every message: after k of them a message knows its ancestor 2 ** k
messages above, and the sum of the scores on the way, so paths of any length take a logarithm of joins. The leaves then have their
path's mean; the best of each root are chosen; and the stored reaches, the longest first, spell out the messages of the chosen paths, again by
joins that double what is found.

An example is written in a template: `<|im_start|>`role, a line feed, text, `<|im_end|>` and a line feed for each turn. Any `<` that backslashes (or none) and a `|` follow gets
one more backslash in roles and texts, so a text holds no control string and is got back exactly; a role also has its backslashes doubled and
its line feeds as `\\n`. Spans of the loss mask hold the texts of chosen roles, in code points of the formatted text.

A row of the output holds `TURNS` turns of a conversation at most and about `PART_BYTES` of text; longer conversations have several rows, in the
order of `part` (the place of its first turn). So a task never holds a conversation whole, and the parts of a long one lie in many tasks.

Null roles and texts are empty; null scores are 0. A message that answers none, or one that isn't there, is a root. Of rows with the same id one
counts, the smallest by parent, role, text and score; a null id is an id of its own row alone. Messages in a circle hang from no root, so they
are on no path. An empty table gives none. Columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import drop_stored, quoted, released, schema, stored
from corvane.llm.ordered import numbered

START, END = "<|im_start|>", "<|im_end|>"
#: Turns and bytes of text of one row of the output.
TURNS, PART_BYTES = 10_000, 8 << 20

# --- Trees ---


def thread(rows: DataFrame, conversation: str, turn: str, role: str = "role", text: str = "text") -> DataFrame:
    """A table of turns as messages (id, parent, tree, role, text, score): each answers the one before it in its conversation.

    Turns with the same number follow by role, then by the sha256 of their text. The range partitioning of `numbered` finds the row before.
    """
    t = rows.select(F.col(quoted(conversation)).alias("tree"), F.col(quoted(turn)).alias("turn"), F.coalesce(F.col(quoted(role)), F.lit("")).alias("role"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.sha2(F.col("text").cast("binary"), 256).asc()]
    return numbered(t, ["tree"], order).select(F.col("row").alias("id"), F.col("before").alias("parent"), "tree", "role", "text", F.lit(0.0).alias("score"))


def _links(messages: DataFrame) -> DataFrame:
    """node (a number of its own), up (the node it answers, or null) and score of each message that counts, and its tree."""
    smallest = F.min(F.struct("parent", "role", F.sha2(F.col("text").cast("binary"), 256), "score", "node"))
    named = messages.where("id is not null").groupBy("id").agg(smallest.getField("node").alias("node"), smallest.getField("parent").alias("parent"))
    score = messages.select(F.col("node").alias("n"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), "tree")
    nameless = messages.where("id is null").select(F.lit(None).cast(messages.schema["id"].dataType).alias("id"), "node", "parent")
    every = stored(named.unionByName(nameless))
    answered = every.where("id is not null").select(F.col("id").alias("above"), F.col("node").alias("up"))
    linked = every.join(answered, F.col("parent") == F.col("above"), "left").join(score, F.col("node") == F.col("n"))
    return stored(linked.select("node", "up", "score", "tree"))


def best_paths(messages: DataFrame, paths: int = 1) -> DataFrame:
    """tree, path (rank of the path among those of its root, from 1), root, at (place on the path) and node, for the chosen paths of messages with a column node."""
    links = _links(messages)
    # A message that has reached its root is done; only the others go on.
    moved = stored(links.select("node", "up", F.when(F.col("up").isNull(), F.col("node")).alias("root"), F.col("score").alias("total"), F.lit(1).cast("long").alias("steps")))
    tables, levels, done = [moved], [moved.where("up is not null")], moved.where("up is null")
    rounds = max(1, links.count()).bit_length()
    while len(levels) <= rounds and not levels[-1].isEmpty():
        above = levels[-1].unionByName(done).toDF("n", "u", "root", "t", "s")
        far = levels[-1].drop("root").join(above, F.col("up") == F.col("n"))
        moved = stored(far.select("node", F.col("u").alias("up"), "root", (F.col("total") + F.col("t")).alias("total"), (F.col("steps") + F.col("s")).alias("steps")))
        tables.append(moved)
        levels.append(moved.where("up is not null"))
        done = done.unionByName(moved.where("up is null"))
    answered = links.where("up is not null").select(F.col("up").alias("n")).distinct()
    leaves = done.join(answered, F.col("node") == F.col("n"), "left_anti")
    by_score = Window.partitionBy("root").orderBy(F.desc(F.col("total") / F.col("steps")), F.desc("steps"), "node")
    chosen = leaves.withColumn("path", F.row_number().over(by_score)).where(F.col("path") <= paths)
    found = [stored(chosen.select("root", "path", F.col("node"), (F.col("steps") - 1).alias("at")))]
    for k in reversed(range(len(levels))):
        so_far = found[0]
        for more in found[1:]:
            so_far = so_far.unionByName(more)
        hop = levels[k].select(F.col("node").alias("n"), "up")
        found.append(stored(so_far.join(hop, F.col("node") == F.col("n")).select("root", "path", F.col("up").alias("node"), (F.col("at") - (1 << k)).alias("at"))))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    trees = links.where("up is null").select(F.col("node").alias("n"), "tree")
    out = stored(out.join(trees, F.col("root") == F.col("n")).select("tree", "path", "root", "at", "node"))
    drop_stored(*found, *tables, links)
    return out


# --- The template ---


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


_ESCAPED, _IN_ROLE = re.compile(r"<\\(\\*)\|"), re.compile(r"\\(\\|n)")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def unescaped_role(role: str) -> str:
    return _IN_ROLE.sub(lambda m: "\n" if m[1] == "n" else "\\", unescaped(role))


def examples(messages: DataFrame, paths: int = 1, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """tree, path, root, part, n_turns, formatted, loss_spans (starts and ends by turns, in code points of formatted) and n_chars, for the best paths of each root.

    messages: id, parent, tree, role, text, score. The rows of an example, ordered by part and put together, are one conversation.
    """
    m = stored(messages.select("id", "parent", "tree", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score").withColumn("node", F.monotonically_increasing_id()))
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    turns = m.select(F.col("node").alias("n"), head.alias("head"), escaped(F.col("text")).alias("body"), F.col("role").isin(*loss_roles).alias("learnt"))
    block = F.expr(f"at div {TURNS}")
    placed = best_paths(m, paths).join(turns, F.col("node") == F.col("n")).select("tree", "path", "root", block.alias("block"), "at", "head", "body", "learnt")
    spec = schema("path int, root long, part long, n_turns long, formatted string, loss_spans array<long>, n_chars long")
    spec = type(spec)([m.schema["tree"], *spec])

    def run(batches):
        now, pieces, spans, chars, size, turns = None, [], [], 0, 0, 0

        def put():
            tree, path, root, part = now
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((tree, path, root, part, turns, "".join(pieces), spans, chars), types, strict=True)], names=spec.names)

        types = None
        for batch in batches:
            types = types or [batch.schema.field("tree").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64()]
            for tree, path, root, block, at, head, body, learnt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or (root, path, block) != key or size > PART_BYTES:
                    if now is not None:
                        yield put()
                    now, key = (tree, path, root, at), (root, path, block)
                    pieces, spans, chars, size, turns = [], [], 0, 0, 0
                if learnt:
                    spans += [chars + len(head), chars + len(head) + len(body)]
                pieces += [head, body, END, "\n"]
                chars += len(head) + len(body) + len(END) + 1
                size += len(body) + len(head)
                turns += 1
        if now is not None:
            yield put()

    dealt = placed.repartition("root", "path", "block").sortWithinPartitions("root", "path", "block", "at")
    return dealt.mapInArrow(released(run), spec)


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a formatted text, as they were before."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        yield unescaped_role(formatted[at + len(START) : line]), unescaped(formatted[line + 1 : end])
        at = end + len(END) + 1


def read_back(formatted: DataFrame) -> DataFrame:
    """tree, path, root, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each example, from its rows' formatted text and spans alone.

    A digest needs the turns in order, so one task reads all rows of an example, part by part, and keeps the state of the digests only.
    """
    spec = schema("path int, root long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    spec = type(spec)([formatted.schema["tree"], *spec])

    def run(batches):
        key, types, state = None, None, None

        def put():
            tree, path, root, turns, seen, chars, learnt, length = state
            values = (tree, path, root, turns, seen.hexdigest(), chars, learnt.hexdigest(), length)
            return [pa.array([x], t) for x, t in zip(values, types, strict=True)]

        for batch in batches:
            types = types or [batch.schema.field("tree").type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done = []
            for tree, path, root, text, spans in zip(*(batch.column(c).to_pylist() for c in ("tree", "path", "root", "formatted", "loss_spans")), strict=True):
                if (root, path) != key:
                    if key is not None:
                        done.append(put())
                    key, state = (root, path), [tree, path, root, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns_of(text):
                    state[3] += 1
                    state[4].update(f"{role}\n{said}\n".encode())
                for start, stop in zip(spans[::2], spans[1::2], strict=True):
                    said = unescaped(text[start:stop])
                    state[5] += len(said)
                    state[6].update(said.encode())
                state[7] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(list(x)) for x in zip(*done, strict=True)], names=spec.names)
        if key is not None:
            yield pa.RecordBatch.from_arrays(put(), names=spec.names)

    dealt = formatted.repartition("root", "path").sortWithinPartitions("root", "path", "part")
    return dealt.mapInArrow(released(run), spec)

"""The prefix trie of conversations by truncation peeling.

A conversation is a path of turn keys; a node of the trie is a distinct path, and the last of its
chained keys names it. The trie is found from its deepest level upwards: records that end at a level
are merged with the nodes that survived from below, a merged record is a node, it loses its last turn
and meets its siblings one level up. What a node needs of its subtree (leaves, children, saved text)
travels with the record, so nodes are discovered and aggregated in one descent.

Levels are peeled several at a time where that is safe: down to the lowest level at which no node
has more than ``GROUP`` nodes' worth of records below it, groups are peeled inside tasks. A level at
which a node has more than that is regrouped alone by partial aggregation, so a turn shared by a
third of all conversations costs a row per task.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.operators.lookup import lookup_join
from tagwright.sources.shared import publish

KEY = 16  # bytes of a node's key
# Nodes that the records of one group may make inside a task.
GROUP = 256
# Ids that differ in these last bits only are brought together before a node's ids are read in order.
CHUNK_BITS = 12
NOTHING = hashlib.sha256(b"").hexdigest()

RECORD = "conv_id long, path binary, chars array<int>"
ENDED = "path binary, chars array<int>, depth int, conv_id long, n_convs long, ends string"
NODE = (
    "node binary, parent binary, depth int, conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends string, path binary, chars array<int>"
)


def _arrow(ddl: str) -> pa.Schema:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, types[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def key_at(depth: int) -> Column:
    """The key of a path's node at ``depth``; the root's is empty."""
    return F.substring("path", KEY * (depth - 1) + 1, KEY) if depth else F.lit(b"")


def paths(conversations: DataFrame, family: Column | None = None, head: Column | None = None) -> DataFrame:
    """``(conv_id, path, chars)``: one record per conversation, with the chained keys of its turns and
    the code points of their texts.

    Turns are ordered by ``turn`` (null first), ties by role, then by a hash of role and text, so
    equal rows count as turns each. Null role or text is empty; rows without ``conv_id`` belong to no
    conversation and are left out. Texts are hashed (128 bits) where they are read and not shuffled.

    ``family`` names the conversation whose first ``head`` turns (all if fewer, none if there is no
    such conversation) stand for a conversation's own first ``head``. It is the least id of those
    that name it. A family is read in order by one task that holds one conversation at a time.
    """
    ids = F.col("conv_id").cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        (ids if family is None else family).cast("long").alias("family"),
        ids.alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit("turn"), text, role).alias("b"),
        F.char_length(text).alias("n"),
        (F.lit(0) if head is None else head).cast("int").alias("head"),
    ).where("conv_id IS NOT NULL")
    dealt = rows.repartition("family").sortWithinPartitions(
        "family", "conv_id", F.asc_nulls_first("turn"), "role", "a", "b"
    )
    schema = _arrow(RECORD)

    def whole(turns: Iterator[tuple]) -> Iterator[tuple]:
        """Each conversation as ``(family, conv_id, head, digests, lengths)``."""
        now: tuple | None = None
        for group, conv, a, b, n, skip in turns:
            if now is None or now[1] != conv:
                if now is not None:
                    yield now
                now = (group, conv, skip, [], [])
            now[3].append(a.to_bytes(8, "big", signed=True) + b.to_bytes(8, "big", signed=True))
            now[4].append(n)
        if now is not None:
            yield now

    def rebuilt(turns: Iterator[tuple]) -> Iterator[tuple]:
        first: tuple[int | None, list, list] = (None, [], [])
        for group, conv, skip, digests, lengths in whole(turns):
            if conv == group:
                first = (group, digests, lengths)
            elif skip:
                shared = first if first[0] == group else (None, [], [])
                digests, lengths = shared[1][:skip] + digests[skip:], shared[2][:skip] + lengths[skip:]
            key, path = b"", []
            for digest in digests:
                key = xxhash.xxh3_128_digest(key + digest)
                path.append(key)
            yield conv, b"".join(path), lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rebuilt(_rows(batches)), schema, 1024)

    return dealt.select("family", "conv_id", "a", "b", "n", "head").mapInArrow(run, RECORD)


def ended(records: DataFrame) -> DataFrame:
    """One row per distinct path that some conversation ends at: ``conv_id`` (the least), ``n_convs``
    and ``ends``, the SHA-256 of their decimal ids in ascending order, comma-joined.

    Ids are first joined within ranges of 4,096 ids; a path's ranges are then read in order by a
    running digest, so the copies of a conversation are never held at once, however many.
    """
    part = F.shiftright("conv_id", CHUNK_BITS)
    names = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = records.groupBy("path", "chars", part.alias("part")).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), names.alias("names")
    )
    dealt = chunks.repartition("path").sortWithinPartitions("path", "conv_id")
    schema = _arrow(ENDED)

    def digested(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, digest = None, None
        for path, chars, conv, n, ids in rows:
            if now is not None and now[0] == path:
                digest.update(b",")
                now[4] += n
            else:
                if now is not None:
                    yield *now, digest.hexdigest()
                now, digest = [path, chars, len(path) // KEY, conv, 0 + n], hashlib.sha256()
            digest.update(ids.encode())
        if now is not None:
            yield *now, digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(digested(_rows(batches)), schema, 1024)

    return dealt.select("path", "chars", "conv_id", "n", "names").mapInArrow(run, ENDED)


def peel(records: Iterable[tuple], floor: int) -> Iterator[tuple]:
    """The nodes at depth ``floor`` and below of the records of one such node, deepest first.

    Records are ``(path, chars, depth, conv_id, n_convs, ends, n_children, n_leaves, saved_tokens)``.
    The node at ``floor`` comes with its path and lengths cut to the level above.
    """
    levels: dict[int, dict[bytes, list]] = defaultdict(dict)

    def meet(key: bytes, depth: int, path, chars, conv, n, ends, children, leaves, saved) -> None:
        at = levels[depth].get(key)
        if at is None:
            levels[depth][key] = [path, chars, conv, n, ends, children, leaves, saved]
            return
        at[2] = min(at[2], conv)
        at[3] += n
        at[4] = at[4] or ends
        at[5] += children
        at[6] += leaves
        at[7] += saved

    for path, chars, depth, *rest in records:
        meet(path[KEY * (depth - 1) : KEY * depth], depth, path, chars, *rest)
    for depth in range(max(levels), floor - 1, -1):
        for key, (path, chars, conv, n, ends, children, leaves, saved) in levels.pop(depth, {}).items():
            above = path[KEY * (depth - 2) : KEY * (depth - 1)] if depth > 1 else b""
            leaves = leaves or 1
            saved += (n - 1) * chars[depth - 1]
            own = (key, above, depth, conv, n, children, leaves, saved, ends)
            if depth > floor:
                yield *own, None, None
                meet(above, depth - 1, path, chars, conv, n, None, 1, leaves, saved)
            else:
                yield *own, path[: KEY * (depth - 1)], chars[: depth - 1]


def _peeled(active: DataFrame, floor: int) -> DataFrame:
    """``peel`` of every node at ``floor``, a group at a time."""
    schema = _arrow(NODE)

    def nodes(rows: Iterator[tuple]) -> Iterator[tuple]:
        top, group = None, []
        for at, *record in rows:
            if at != top and group:
                yield from peel(group, floor)
                group = []
            top = at
            group.append(record)
        if group:
            yield from peel(group, floor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(nodes(_rows(batches)), schema)

    dealt = active.withColumn("top", key_at(floor)).repartition("top").sortWithinPartitions("top")
    return dealt.select("top", *active.columns).mapInArrow(run, NODE)


def _level(active: DataFrame, depth: int) -> DataFrame:
    """The nodes of one level, from the records that end there; any number may meet in a node."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    met = active.groupBy(key_at(depth).alias("node")).agg(
        F.min("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends"),
        F.any_value("path").alias("path"), F.any_value("chars").alias("chars"),
    )
    last = F.element_at("chars", -1) if depth else F.lit(0)
    return met.select(
        "node",
        (key_at(depth - 1) if depth else F.lit(None).cast("binary")).alias("parent"),
        F.lit(depth).alias("depth"),
        "conv_id",
        "n_convs",
        "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * last).alias("saved_tokens"),
        "ends",
        F.substring("path", 1, KEY * (depth - 1)).alias("path") if depth else F.lit(None).cast("binary").alias("path"),
        F.slice("chars", 1, max(depth - 1, 0)).alias("chars"),
    )


def _survivors(level: DataFrame, depth: int) -> DataFrame:
    """The nodes of ``depth`` as records that end one level up, met by that level's node already."""
    return level.where(F.col("depth") == depth).select(
        "path", "chars", F.lit(depth - 1).alias("depth"), "conv_id", "n_convs", F.lit(None).cast("string").alias("ends"),
        F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
    )


def floor_of(active: DataFrame, top: int, group: int) -> int:
    """The lowest of a ladder of levels at which the records below any node make at most ``group``
    nodes; ``top`` itself if there is none."""
    ladder = sorted({max(1, top - (1 << i) + 1) for i in range(top.bit_length() + 1)})
    steps = F.filter(F.array(*map(F.lit, ladder)), lambda x: x <= F.col("depth"))
    held = active.select("path", "depth", F.explode(steps).alias("floor"))
    at = F.substring(F.col("path"), F.lit(KEY) * (F.col("floor") - 1) + 1, F.lit(KEY))
    sizes = held.groupBy("floor", at.alias("at")).agg(F.sum(F.col("depth") - F.col("floor") + 1).alias("n"))
    most = {r[0]: r[1] for r in sizes.groupBy("floor").agg(F.max("n")).collect()}
    return min((x for x in ladder if most.get(x, 0) <= group), default=top)


def trie(records: DataFrame, group: int = GROUP) -> DataFrame:
    """The nodes of the trie over ``records`` (``paths``): ``conv_id`` (the least member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    A node is known by its least member and its depth. The root has depth 0 and a null parent; no
    records, no root. ``saved_tokens`` counts what members beyond a node's first need not repeat, in
    code points, over the node's subtree. Every round is written to the shared folder.
    """
    over = publish(ended(records), "ended")
    fresh = over.select(
        "path", "chars", "depth", "conv_id", "n_convs", "ends",
        *[F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")],
    )
    top = over.agg(F.max("depth")).first()[0]
    found, left = [], None
    while top is not None and top >= 0:
        waiting = fresh.where(F.col("depth") <= top)
        records_here = waiting if left is None else waiting.unionByName(left)
        floor = floor_of(records_here, top, group) if top else 0
        active = records_here.where(F.col("depth") >= floor)
        level = publish(_peeled(active, floor) if floor < top else _level(active, top), "trie-nodes")
        found.append(level)
        left = _survivors(level, floor)
        top = floor - 1
    if not found:
        found = [_level(fresh, 0)]
    nodes = reduce(DataFrame.unionByName, found)
    parents = nodes.where("n_children > 0").select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_weight")
    )
    return lookup_join(nodes, parents, "parent", weight="_weight").select(
        "conv_id",
        F.col("depth").cast("long"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
    )

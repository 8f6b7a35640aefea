"""Exact top-k by inner product with MaxScore over shards of vectors.

Components are terms, a vector's entries their postings. Each shard stores its vectors term by term
(integers) with the least and greatest value of every term, which bounds what a term can add to a
query's score. Per query and shard, terms are ordered by how much they can move the score; those
that cannot lift a vector from the floor of the others to the current k-th best score are
non-essential. Essential postings are traversed for all vectors; the others are probed, a few terms
at a time, only for vectors whose score so far plus the bound of what is left is still competitive.

Shards are dealt into groups and shuffled once. A task holds the shards of one group and streams all
blocks of queries past them, so a query's best of a whole group raises the bar for its later shards;
the ``k`` best per query and group are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagwright.sources.shared import publish

SHARD_VECTORS = 8192
SHARD_VALUES = 1 << 19
# Shards that a task holds, about: 32 take 64 MB as four-byte numbers.
TASK_SHARDS = 32
BLOCK_QUERIES = 256
# Terms probed between two looks at which vectors are still competitive.
PROBE = 8

_SHARD = "ids binary, terms int, kind string, postings binary"


def _packed(ids: list[int], vectors: list[list[int]]) -> tuple[bytes, int, str, bytes]:
    """Vectors term by term, in the narrowest integers; shorter ones are filled up with zeros."""
    terms = max([0, *map(len, vectors)])
    matrix = np.zeros((terms, len(vectors)), np.int64)
    for i, v in enumerate(vectors):
        matrix[: len(v), i] = v
    top = max(abs(int(matrix.max(initial=0))), abs(int(matrix.min(initial=0))))
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return np.array(ids, "<i8").tobytes(), terms, kind, matrix.astype(kind).tobytes()


def _unpacked(ids: bytes, terms: int, kind: str, postings: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, "<i8")
    return own, np.frombuffer(postings, kind).reshape(terms, len(own))


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, v)`` with components ``floor(scale * x)``. Rows without id or vector, or with a
    component that is null or not finite, take no part."""
    x = F.col("embedding")
    sound = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    kept = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, sound))
    return kept.select(
        F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v")
    )


def _shards(rows: DataFrame) -> DataFrame:
    """Rows in shards of at most ``SHARD_VECTORS`` vectors and about ``SHARD_VALUES`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([c], t) for c, t in zip(_packed(ids, vectors), [pa.binary(), pa.int32(), pa.string(), pa.binary()])],
                ["ids", "terms", "kind", "postings"],
            )

        for batch in batches:
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(key)
                vectors.append(v)
                if len(ids) == SHARD_VECTORS or len(ids) * len(v) >= SHARD_VALUES:
                    yield row()
                    ids, vectors = [], []
        if ids:
            yield row()

    return rows.mapInArrow(run, _SHARD)


class _Best:
    """The k best of one query so far: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def bar(self) -> int | None:
        return int(self.scores[-1]) if len(self.scores) == self.k else None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            # Everything that ties with the k-th stays until ids decide.
            kth = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            near = scores >= kth
            scores, ids = scores[near], ids[near]
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def _search(best: _Best, own: int, q: np.ndarray, ids: np.ndarray, postings: np.ndarray, high: np.ndarray, low: np.ndarray) -> None:
    """One query against one shard."""
    upper, lower = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
    others = ids != own
    bar = best.bar
    if bar is None:
        scores = q @ postings
        best.add(scores[others].astype(np.int64), ids[others])
        return
    order = np.argsort(lower - upper, kind="stable")  # widest range first
    # Bound of the terms from each place on, and floor of the terms before it.
    rest = np.append(np.cumsum(upper[order][::-1])[::-1], 0)
    floor = np.insert(np.cumsum(lower[order]), 0, 0)
    essential = int(np.argmax(rest + floor < bar)) if (rest + floor < bar).any() else len(order)
    head = order[:essential]
    scores, alive = q[head] @ postings[head], others
    for at in range(essential, len(order) + PROBE, PROBE):
        alive = alive & (scores + rest[min(at, len(order))] >= bar)
        if at >= len(order) or not alive.any():
            break
        terms = order[at : at + PROBE]
        if alive.mean() > 0.25:
            scores = scores + q[terms] @ postings[terms]
        else:
            # Few are left: they alone go on.
            scores, ids = scores[alive], ids[alive]
            postings = postings[:, alive]
            alive = np.ones(len(ids), bool)
            scores = scores + q[terms] @ postings[terms]
    if alive.any():
        best.add(scores[alive].astype(np.int64), ids[alive])


class _Shard:
    """A shard's vectors term by term, and each term's bounds, as numbers of the type last asked for."""

    def __init__(self, ids: np.ndarray, postings: np.ndarray):
        self.ids, self.postings, self.data = ids, postings, np.empty((0, 0))
        self.top = _largest(postings)

    def bounded(self, terms: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.data.dtype != kind or len(self.data) != terms:
            self.data = self.postings[:terms].astype(kind)
            empty = np.zeros(terms, kind)
            self.high = self.data.max(axis=1) if self.data.size else empty
            self.low = self.data.min(axis=1) if self.data.size else empty
        return self.data, self.high, self.low


def _largest(numbers: np.ndarray) -> int:
    """The greatest absolute value, one at least."""
    return max(1, int(numbers.max(initial=0)), -int(numbers.min(initial=0)))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows one at a time: a row may hold a whole shard."""
    for i in range(batch.num_rows):
        yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def _answers(ids: np.ndarray, wanted: np.ndarray, shards: list[_Shard], k: int) -> pa.RecordBatch:
    """The ``k`` best of all shards for each query of a block."""
    best, top = [_Best(k) for _ in ids], _largest(wanted)
    for shard in shards:
        terms = min(len(shard.postings), len(wanted))  # what one side lacks counts as zero
        limit = terms * top * shard.top
        # The narrowest type in which every partial score is exact.
        kind = np.float32 if limit < 1 << 24 else np.float64 if limit < 1 << 53 else np.int64
        data, high, low = shard.bounded(terms, kind)
        asked = wanted[:terms].astype(kind)
        for j, own in enumerate(ids):
            _search(best[j], int(own), asked[:, j], shard.ids, data, high, low)
    found = [(int(q), int(i), int(s)) for q, b in zip(ids, best) for i, s in zip(b.ids, b.scores)]
    columns = zip(*found) if found else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` highest inner products with the
    candidates of other ids (all, if there are fewer); ties go to the smaller id.

    Both tables hold ``vec_id, v`` as ``quantised`` gives them. Queries that repeat an id count once
    (the least vector); candidates that repeat one count each. Every shard is shuffled once, every
    block of queries once per group of shards; a task holds one group and one block at a time.
    """
    shards = publish(_shards(candidates.select("vec_id", "v")), "vector-shards")
    groups = max(12, -(-shards.count() // TASK_SHARDS))
    asked = publish(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        row = _packed(group["vec_id"].tolist(), [list(v) for v in group["v"]])
        return pd.DataFrame([row], columns=["ids", "terms", "kind", "postings"])

    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    packed = dealt.groupBy("block").applyInPandas(pack, _SHARD)
    to_all = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    by_group = packed.select(to_all.alias("part"), F.lit(True).alias("asks"), "ids", "terms", "kind", "postings")
    dealt_shards = shards.select(
        F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("part"), F.lit(False).alias("asks"), *shards.columns
    )
    # A group's shards come first, then every block of queries.
    met = dealt_shards.unionByName(by_group).repartition(groups, "part").sortWithinPartitions("part", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for row in _rows(batch):
                if row["part"] != part:
                    part, held = row["part"], []
                stored = _unpacked(row["ids"], row["terms"], row["kind"], row["postings"])
                if row["asks"]:
                    if held:
                        yield _answers(*stored, held, k)
                else:
                    held.append(_Shard(*stored))

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )

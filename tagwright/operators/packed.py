"""Hashed cells as bytes, one row per listing: per hashed block a column of buckets and one of values.

A row's buckets ascend and are kept as steps from one to the next, so that a written cell takes some three
bytes. Counts are made and shuffled as runs of ascending numbers as well, by ranges of buckets, and a fitted
table of counts is bounded by the number of buckets: it goes to every worker as one byte a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS, VALUES = "keys:", "values:"
STEP, VALUE = np.dtype("<u4"), np.dtype("<f8")
# Buckets whose counts are added up together, and cells or table rows that are held at a time.
RANGE, HELD = 1 << 20, 1 << 22
# A fitted table of one block that goes to every worker takes so many bytes at most.
MOST_BYTES = 256 << 20
RUNS = "block string, part int, n long, keys binary, counts binary"
# Counts from here on are looked up in a list of their own.
MANY = 255


def names(columns: Sequence[str]) -> list[str]:
    """The hashed blocks whose cells the columns hold."""
    return [c.removeprefix(KEYS) for c in columns if c.startswith(KEYS)]


def binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """``data`` cut at ``ends`` (a row more than rows, from 0), as bytes."""
    offsets = np.ascontiguousarray(ends * data.itemsize, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def steps(ends: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Buckets as steps within their row."""
    out = np.diff(bucket, prepend=0)
    first = ends[:-1][np.diff(ends) > 0]
    out[first] = bucket[first]
    return out.astype(STEP)


def _flat(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    own = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return (ends - ends[0]) // kind.itemsize, own.view(kind)


def cells(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of all cells of a block."""
    ends, step = _flat(batch.column(KEYS + name), STEP)
    _, value = _flat(batch.column(VALUES + name), VALUE)
    return _rows(ends), _buckets(ends, step), value


def pieces(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` cells."""
    total = sum((_flat(batch.column(KEYS + b), STEP)[0] for b in names(batch.schema.names)), np.zeros(batch.num_rows + 1, np.int64))
    first = 0
    while first < batch.num_rows:
        end = max(first + 1, int(np.searchsorted(total, total[first] + most, "right")) - 1)
        yield batch.slice(first, end - first)
        first = end


def _rows(ends: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends))


def _buckets(ends: np.ndarray, step: np.ndarray) -> np.ndarray:
    total = np.cumsum(step, dtype=np.int64)
    some = np.diff(ends) > 0
    first = ends[:-1][some]
    return total - np.repeat(total[first] - step[first], np.diff(ends)[some])


# ---- counts -----------------------------------------------------------------------------------


def _run(block: str, part: int, keys: np.ndarray, counts: np.ndarray) -> tuple:
    found = [np.diff(keys, prepend=0), counts]
    return block, part, len(keys), *[pa.compress(x.astype(STEP).tobytes(), "zstd", asbytes=True) for x in found]


def _of_run(n: int, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.frombuffer(pa.decompress(x, n * STEP.itemsize, "zstd", asbytes=True), STEP) for x in (keys, counts))
    return np.cumsum(keys, dtype=np.int64), counts


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


RUN = pa.schema([("block", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def counted(stacked: DataFrame) -> DataFrame:
    """``(block, feature, df, _train)`` of hashed cells: the rows of each bucket, and those of them in the
    split ``train`` (0 if rows have no ``split``). A task adds up equal buckets before they are shuffled."""
    blocks, spark = names(stacked.columns), stacked.sparkSession
    train = F.coalesce(F.col("split") == "train", F.lit(False)) if "split" in stacked.columns else F.lit(False)
    given = stacked.select(train.alias("train"), *[f"`{KEYS}{b}`" for b in blocks])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {b: [] for b in blocks}
        size = dict.fromkeys(blocks, 0)

        def summed(block: str) -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(held[block]), return_counts=True)
            held[block], size[block] = [], 0
            edges = np.flatnonzero(np.diff(keys // (2 * RANGE), prepend=-1))
            for first, end in zip(edges, np.r_[edges[1:], len(keys)]):
                part = int(keys[first] // (2 * RANGE))
                yield _batch([_run(block, part, keys[first:end] - part * 2 * RANGE, counts[first:end])], RUN)

        for batch in (piece for batch in batches for piece in pieces(batch)):
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, block in enumerate(blocks):
                ends, step = _flat(batch.column(i + 1), STEP)
                held[block].append(_buckets(ends, step) * 2 + own[_rows(ends)])
                size[block] += len(step)
                if size[block] >= HELD:
                    yield from summed(block)
        for block in blocks:
            if size[block]:
                yield from summed(block)

    out = pa.schema([("block", pa.string()), ("feature", pa.string()), ("df", pa.int64()), ("_train", pa.int64())])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, np.zeros(2 * RANGE, np.int64)

        def done() -> Iterator[pa.RecordBatch]:
            counts = sums.reshape(-1, 2)
            number = np.flatnonzero(counts.any(1))
            for some in np.array_split(number, -(-len(number) // (1 << 16)) or 1):
                feature = pa.array(some + at[1] * RANGE).cast(pa.string())
                found = [pa.repeat(at[0], len(some)), feature, pa.array(counts[some].sum(1)), pa.array(counts[some, 1])]
                yield pa.RecordBatch.from_arrays(found, schema=out)

        for batch in batches:
            for block, part, *run in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (block, part):
                    if at is not None:
                        yield from done()
                    at = (block, part)
                    sums[:] = 0
                keys, counts = _of_run(*run)
                sums[keys] += counts
        if at is not None:
            yield from done()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = given.mapInArrow(partial, RUNS).repartition(parts, "block", "part").sortWithinPartitions("block", "part")
    return runs.mapInArrow(together, "block string, feature string, df long, _train long")


# ---- fitted tables that go to every worker ----------------------------------------------------


@dataclass(frozen=True)
class Counts:
    """The count of every bucket, 0 for those not in the table: ``few`` by bucket, or with ``listed`` ascending
    buckets and their counts in ``few``; what does not fit a byte is in ``many`` and ``amounts``."""

    few: np.ndarray
    listed: np.ndarray | None
    many: np.ndarray
    amounts: np.ndarray

    def of(self, bucket: np.ndarray) -> np.ndarray:
        if not len(self.few):
            return np.zeros(len(bucket), np.int64)
        if self.listed is None:
            inside = bucket < len(self.few)
            found = np.where(inside, self.few.take(bucket, mode="clip"), 0).astype(np.int64)
        else:
            at = np.minimum(np.searchsorted(self.listed, bucket), len(self.listed) - 1)
            found = np.where(self.listed[at] == bucket, self.few[at], 0).astype(np.int64)
        large = np.flatnonzero(found == MANY)
        found[large] = self.amounts[np.searchsorted(self.many, bucket[large])]
        return found


def fitted_counts(table: DataFrame, block: str, most: int | None = None) -> Counts | None:
    """``Counts`` of a block from a table ``(block, feature, df)`` with each bucket once; none if they take
    more than ``most`` bytes."""
    most = MOST_BYTES if most is None else most
    own = table.where((F.col("block") == block) & F.col("feature").rlike("^(0|[1-9][0-9]{0,9})$"))
    own = own.select(F.col("feature").cast("long").alias("key"), F.col("df").cast("long").alias("df")).where("df > 0")
    n, top, bad = own.agg(F.count(F.lit(1)), F.max("key"), F.max("df")).first()
    wide = (top or 0) + 1 if n else 0
    if min(wide, 9 * n) > most or wide > 1 << 32 or (bad or 0) >= 1 << 32:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sorted_run() -> Iterator[pa.RecordBatch]:
            key, df = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key)
            yield _batch([_run(block, 0, key[order], df[order])], RUN)

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size >= HELD:
                yield from sorted_run()
                held, size = [], 0
        if size:
            yield from sorted_run()

    dense = wide <= 9 * n
    few, keys, small = np.zeros(wide if dense else 0, np.uint8), [], []
    many, amounts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for row in own.mapInArrow(run, RUNS).select("n", "keys", "counts").collect():
        key, df = _of_run(*row)
        byte = np.minimum(df, MANY).astype(np.uint8)
        if dense:
            few[key] = byte
        else:
            keys.append(key)
            small.append(byte)
        many.append(key[byte == MANY])
        amounts.append(df[byte == MANY].astype(np.int64))
    many, amounts = np.concatenate(many), np.concatenate(amounts)
    order = np.argsort(many)
    if dense:
        return Counts(few, None, many[order], amounts[order])
    listed, small = np.concatenate(keys or [np.empty(0, np.int64)]), np.concatenate(small or [few])
    place = np.argsort(listed)
    return Counts(small[place], listed[place], many[order], amounts[order])


def text_rank(number: np.ndarray, wide: int) -> np.ndarray:
    """The place of each number, written out, among the texts of all numbers below ``wide`` in their order."""
    tens = 10 ** np.arange(11, dtype=np.int64)
    digits = np.maximum(np.searchsorted(tens, number, "right"), 1)
    out = np.zeros(len(number), np.int64)
    for size in range(1, len(str(max(wide - 1, 0))) + 1):
        low, high = (0 if size == 1 else tens[size - 1]), min(tens[size], wide)
        cut = tens[np.maximum(digits - size, 0)]
        # Those of this size below the number's own first digits, which is itself one if there are more digits.
        short = number // cut - low + (digits > size)
        long = np.clip(number * tens[np.maximum(size - digits, 0)], low, high) - low
        out += np.where(digits >= size, short, long)
    return out


@dataclass(frozen=True)
class Places:
    """The index of every bucket, -1 for those without one, where indices follow the texts of the buckets: a bit
    per bucket in that order, and how many are set before each word of bits."""

    words: np.ndarray
    before: np.ndarray
    first: int
    wide: int

    def of(self, bucket: np.ndarray) -> np.ndarray:
        if not self.wide:
            return np.full(len(bucket), -1, np.int64)
        inside = bucket < self.wide
        at = text_rank(np.where(inside, bucket, 0), self.wide)
        word, bit = self.words[at >> 6], np.uint64(1) << (at & 63).astype(np.uint64)
        found = self.first + self.before[at >> 6] + np.bitwise_count(word & (bit - np.uint64(1)))
        return np.where(inside & ((word & bit) != 0), found, -1)


def fitted_places(table: DataFrame, block: str, most: int | None = None) -> Places | None:
    """``Places`` of a block from a table ``(block, feature, index)`` with each bucket once; none if they take
    more than ``most`` bytes or the indices do not follow the texts without a gap, as those of ``dense_index`` do."""
    most = MOST_BYTES if most is None else most
    own = table.where((F.col("block") == block) & F.col("feature").rlike("^(0|[1-9][0-9]{0,9})$") & F.col("index").isNotNull())
    own = own.select(F.col("feature").cast("long").alias("key"), F.col("index").cast("long").alias("index"))
    n, top = own.agg(F.count(F.lit(1)), F.max("key")).first()
    wide = top + 1 if n else 0
    if wide // 4 > most or wide > 1 << 32:
        return None
    schema = pa.schema([("n", pa.int64()), ("start", pa.int64()), ("ranks", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def ordered() -> Iterator[pa.RecordBatch]:
            key, index = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(index)
            rank, index = text_rank(key[order], wide), index[order]
            if (np.diff(rank) <= 0).any():
                yield _batch([(-1, 0, b"")], schema)
                return
            edges = np.flatnonzero(np.diff(index, prepend=-2) != 1)
            for a, b in zip(edges, np.r_[edges[1:], len(index)]):
                ranks = np.diff(rank[a:b], prepend=0).astype(STEP).tobytes()
                yield _batch([(int(b - a), int(index[a]), pa.compress(ranks, "zstd", asbytes=True))], schema)

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size >= HELD:
                yield from ordered()
                held, size = [], 0
        if size:
            yield from ordered()

    words = np.zeros(-(-wide // 64), np.uint64)
    bits = words.view(np.uint8)
    runs = sorted(own.mapInArrow(run, "n long, start long, ranks binary").collect(), key=lambda r: r["start"])
    last, following = -1, None
    for n, start, ranks in runs:
        if n < 0 or following not in (None, start):
            return None
        rank = np.cumsum(np.frombuffer(pa.decompress(ranks, n * STEP.itemsize, "zstd", asbytes=True), STEP), dtype=np.int64)
        if rank[0] <= last:
            return None
        np.bitwise_or.at(bits, rank >> 3, (1 << (rank & 7)).astype(np.uint8))
        last, following = rank[-1], start + n
    before = np.cumsum(np.bitwise_count(words), dtype=np.int64)
    return Places(words, np.r_[0, before[:-1]] if wide else before, runs[0]["start"] if runs else 0, wide)

"""Token ids in binary shards, with constant-time access by document key.

``write`` lays out a folder: ``payload`` holds the raw ids of whole documents in ascending key
order, in blocks of at most ``BLOCK_IDS`` ids (a longer document has a block of its own), each block
with its shard and the lengths of its documents; ``shards`` says how many ids come before each
shard; ``index`` holds one row per bucket of keys: a minimal perfect hash of the bucket's keys, and
in the slots it points at a fingerprint of the key and the place of the document.

All files are written by Spark's committers, so repeated or lost tasks leave nothing half done.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagwright.llm.tokens import library_encoder
from tagwright.sources.shared import fresh_path, publish

BLOCK_IDS = 1 << 20
BUCKET_KEYS = 20_000
# Bits per key left at each level of the hash; fewer levels for more bits.
SPREAD = 2


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of each key (the finaliser of splitmix64)."""
    step, a, b = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + step * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * a
        x = (x ^ (x >> np.uint64(27))) * b
        return x ^ (x >> np.uint64(31))


class MinimalPerfectHash:
    """Distinct 64-bit keys to 0..n-1 without gaps.

    Level by level, the keys left are hashed to twice as many bits; those alone on a bit set it, the
    others go on. A key's number is how many bits are set before its own.
    """

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes, self.bits = sizes, bits
        self.set = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool) if bits else np.zeros(0, bool)
        self.before = np.cumsum(self.set) - self.set

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        left, sizes, levels = np.asarray(keys, np.int64), [], []
        while len(left):
            size = SPREAD * len(left)
            at = (_mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            sizes.append(size)
            left = left[~alone[at]]
        return cls(sizes, np.packbits(np.concatenate(levels)).tobytes() if levels else b"")

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 if it is certain that the key was not among those built on."""
        keys = np.asarray(keys, np.int64)
        found, start = np.full(len(keys), -1, np.int64), 0
        for level, size in enumerate(self.sizes):
            at = start + (_mixed(keys, level) % np.uint64(size)).astype(np.int64)
            here = (found < 0) & self.set[at]
            found[here] = self.before[at[here]]
            start += size
        return found


def fingerprints(keys: np.ndarray) -> np.ndarray:
    """32 bits of each key, independent of the levels of the hash."""
    return (_mixed(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def _shards(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """Payload blocks. ``docs`` is dealt by ranges of keys and sorted before it is encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = library_encoder(tokenizer, width), TaskContext.get().partitionId()
        end, block, held, first = np.array([end_id], f"<u{width}"), [], 0, 0
        number = 0

        def row() -> pa.RecordBatch:
            keys = [k for k, _ in block]
            sizes = np.array([len(x) for _, x in block], np.int64)
            values = [shard, number, first, int(sizes.sum()), np.concatenate([x for _, x in block]).tobytes(), keys, sizes.tolist()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _BLOCK_TYPES)], _BLOCK_NAMES)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, ids, counts in encoder.batches(texts):
                stops = np.cumsum(counts)
                for i, (stop, count) in enumerate(zip(stops.tolist(), counts.tolist())):
                    if block and held + count + 1 > BLOCK_IDS:
                        yield row()
                        first, number, block, held = first + held, number + 1, [], 0
                    block.append((keys[at + i], np.concatenate([ids[stop - count : stop], end])))
                    held += count + 1
        if block:
            yield row()

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, _BLOCK)


_BLOCK = "shard int, block int, first long, ids long, payload binary, keys array<long>, lengths array<long>"
_BLOCK_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]
_BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
_INDEX = "bucket int, sizes array<long>, bits binary, prints binary, shard binary, start binary, length binary, documents binary"


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _index_row(group: pd.DataFrame) -> pd.DataFrame:
    keys = group["doc_id"].to_numpy(np.int64)
    mph = MinimalPerfectHash.build(keys)
    at = mph.slots(keys)

    def laid(values: np.ndarray, dtype: str) -> bytes:
        out = np.empty(len(keys), dtype)
        out[at] = values
        return out.tobytes()

    columns = [("shard", "<i4"), ("start", "<i8"), ("length", "<i8"), ("documents", "<i8")]
    return pd.DataFrame(
        {
            "bucket": [int(group["bucket"].iloc[0])],
            "sizes": [mph.sizes],
            "bits": [mph.bits],
            "prints": [laid(fingerprints(keys), "<u4")],
            **{name: [laid(group[name].to_numpy(), dtype)] for name, dtype in columns},
        }
    )


def places(payload: DataFrame) -> DataFrame:
    """``(doc_id, shard, start, length)`` of every document, from the blocks' lengths alone."""
    step = F.transform("lengths", lambda n, i: F.struct(F.get("keys", i).alias("key"), n.alias("n")))
    rows = payload.select("shard", "first", F.posexplode(step).alias("at", "d"), "block")
    before = Window.partitionBy("shard", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("first") + F.coalesce(F.sum("d.n").over(before), F.lit(0))
    return rows.select(F.col("d.key").alias("doc_id"), "shard", start.alias("start"), F.col("d.n").alias("length"))


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, width: int = 2) -> None:
    """Encode whole texts (null: empty) and write payload, shard table and index below ``folder``.

    Documents without a key come first, in the payload only. Documents that repeat a key lie side by
    side; the index points at the first and says how many there are. ``width`` is the bytes per id.
    """
    spark = docs.sparkSession
    _shards(docs, tokenizer, end_id, width).write.option("compression", "none").parquet(f"{folder}/payload")
    payload = spark.read.parquet(f"{folder}/payload")

    per_shard = payload.groupBy("shard").agg(F.sum("ids").alias("ids"))
    # One row per shard: the only window without keys.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per_shard.select("shard", "ids", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before")).write.parquet(
        f"{folder}/shards"
    )

    found = places(payload.drop("payload")).where("doc_id IS NOT NULL")
    by_key = found.groupBy("doc_id").agg(
        F.min(F.struct("shard", "start", "length")).alias("p"), F.count(F.lit(1)).alias("documents")
    )
    by_key = by_key.select("doc_id", "p.*", "documents")
    n = payload.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    buckets = max(1, -(-n // BUCKET_KEYS))
    # Keys are distinct and dealt by hash, so every bucket has about BUCKET_KEYS of them.
    by_key.withColumn("bucket", _bucket("doc_id", buckets)).groupBy("bucket").applyInPandas(
        _index_row, _INDEX
    ).withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/index")


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, shard, start, length, documents)`` of the distinct ``doc_id`` of ``keys`` that the
    index has. Keys go to their bucket's row by a join; there each costs a constant number of steps.
    """
    spark = keys.sparkSession
    index = spark.read.parquet(f"{folder}/index")
    head = index.select("buckets").first()
    buckets = head[0] if head else 1
    asked = keys.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()
    asked = asked.withColumn("bucket", _bucket("doc_id", buckets))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = [("shard", "<i4"), ("start", "<i8"), ("length", "<i8"), ("documents", "<i8")]
        if not len(left) or not len(right):
            return pd.DataFrame({"doc_id": np.empty(0, np.int64), **{c: np.empty(0, t) for c, t in columns}})
        row, wanted = right.iloc[0], left["doc_id"].to_numpy(np.int64)
        at = MinimalPerfectHash(list(row["sizes"]), row["bits"]).slots(wanted)
        prints = np.frombuffer(row["prints"], "<u4")
        hit = (at >= 0) & (prints[np.maximum(at, 0)] == fingerprints(wanted))
        found = {c: np.frombuffer(row[c], t)[at[hit]] for c, t in columns}
        return pd.DataFrame({"doc_id": wanted[hit], **found})

    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(
        run, "doc_id long, shard int, start long, length long, documents long"
    )


def read_digests(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """``(shard, start, n_tokens, ids_crc32)`` of every document, from the payload's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, payload, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(payload, f"<u{width}").astype("<u4")
                stops = np.cumsum(lengths)
                crc = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(stops.tolist(), lengths)]
                columns = [
                    pa.array(np.full(len(lengths), shard, np.int32)),
                    pa.array(first + stops - np.array(lengths, np.int64)),
                    pa.array(lengths, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "start", "n_tokens", "ids_crc32"])

    payload = spark.read.parquet(f"{folder}/payload").select("shard", "first", "payload", "lengths")
    return payload.mapInArrow(run, "shard int, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all of ``docs``, then find every document through the index and read it back:
    ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    Documents that repeat a key follow the first one; those without a key have a null ``doc_id``.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "token-index")
    write(docs, folder, tokenizer, end_id)
    digests = read_digests(spark, folder)
    named = lookup(docs.select("doc_id"), folder).select("doc_id", "shard", "start")
    found = publish(digests.join(named, ["shard", "start"], "left"), "read-back")
    # A document that the index does not point at repeats the key before it or has none.
    rest = places(spark.read.parquet(f"{folder}/payload").drop("payload")).select(
        F.col("doc_id").alias("stored"), "shard", "start"
    )
    shards = spark.read.parquet(f"{folder}/shards").select("shard", "before")
    unnamed = found.where("doc_id IS NULL").drop("doc_id").join(rest, ["shard", "start"])
    both = found.where("doc_id IS NOT NULL").unionByName(unnamed.withColumnRenamed("stored", "doc_id"))
    return both.join(shards, "shard").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )

"""Near-duplicates by SimHash and covering locality-sensitive hashing.

A fingerprint has 64 bits. ``2 ** (r + 1) - 1`` masks are built so that any two fingerprints that
differ in at most ``r`` bits agree under at least one of them: every bit position gets a non-zero
vector of ``r + 1`` bits, mask ``v`` holds the positions whose vector has odd overlap with ``v``, and
the ``r`` differing positions always leave some ``v`` orthogonal to all of their vectors. So tables
keyed by the masked fingerprint lose no link; every candidate is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.llm.components import components
from tagwright.operators.lookup import lookup_join
from tagwright.sources.shared import publish

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
# Buckets up to this size are compared by a join, larger ones in blocks inside tasks.
SMALL_BUCKET = 32
# Members of a large bucket compared at once (two such blocks meet in one task).
BLOCK = 2048

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of the word shingles of ``text``, repeats included.

    Letters A-Z are lowered; words end at ASCII white space. A text of fewer words is one shingle, a
    text without words (or null) has fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        digests = xxhash.xxh64_digest(joined, seed)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[s:e], seed) for s, e in spans])
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(rows), 16384):
        ones += np.unpackbits(rows[i : i + 16384], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(rows)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``(doc_id, fingerprint)`` with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, fingerprint long"
    )


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The masks as signed longs. Vectors are dealt in turn, so all masks hold about half the bits."""
    vectors = 2 ** (radius + 1) - 1
    masks = []
    for v in range(1, vectors + 1):
        bits = sum(1 << i for i in range(BITS) if ((1 + i % vectors) & v).bit_count() % 2)
        masks.append(bits - (1 << BITS) if bits >> (BITS - 1) else bits)
    return masks


def _forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links within one block: each print is compared with those
    not reached yet, so a tight block costs few comparisons and gives fewer edges than members.
    Bits are counted unsigned: numpy counts those of the absolute value of a signed number."""
    left, edges = np.unique(prints).view(np.uint64), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                reached = left[near]
                edges.extend((int(at.view(np.int64)), int(x)) for x in reached.view(np.int64))
                queue.extend(reached)
                left = left[~near]
    return edges


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints (column ``fingerprint``) that connect exactly
    those linked by chains of differences of at most ``radius`` bits.

    Buckets up to ``SMALL_BUCKET`` give all their links by a join. A larger bucket is cut into
    blocks; every two blocks meet in one task, which returns a spanning forest, so the rows made
    stay below members times blocks, whatever the number of links.
    """
    masks = F.array(*[F.struct(F.lit(i).alias("mask"), F.lit(m).alias("bits")) for i, m in enumerate(covering_masks(radius))])
    rows = prints.select("fingerprint", F.explode(masks).alias("m")).select(
        F.col("m.mask").alias("mask"), F.col("fingerprint").bitwiseAND(F.col("m.bits")).alias("bucket"), "fingerprint"
    )
    counted = rows.groupBy("mask", "bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = publish(rows.join(publish(counted, "buckets"), ["mask", "bucket"]), "bucket-members")

    small = shared.where(F.col("members") <= SMALL_BUCKET).drop("members")
    other = small.withColumnRenamed("fingerprint", "b")
    near = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("b"))) <= radius
    pairs = small.join(other, ["mask", "bucket"]).where((F.col("fingerprint") < F.col("b")) & near)
    pairs = pairs.select(F.col("fingerprint").alias("a"), "b").distinct()

    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    large = shared.where(F.col("members") > SMALL_BUCKET).withColumn(
        "own", F.pmod(F.xxhash64("fingerprint"), blocks.cast("long")).cast("int")
    )
    met = large.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "mask", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fingerprint"
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        edges = _forest(group["fingerprint"].to_numpy(np.int64), radius)
        return pd.DataFrame(np.array(edges, np.int64).reshape(-1, 2), columns=["a", "b"])

    return pairs.union(met.groupBy("mask", "bucket", "i", "j").applyInPandas(run, "a long, b long"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the least ``doc_id`` that chains of
    links reach. Null texts count as texts without words. Repeated rows each get a row. Only
    ``doc_id`` and ``text`` are read, so other columns cannot clash.
    """
    prints = publish(fingerprints(docs), "fingerprints")
    counted = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    distinct = publish(counted, "distinct-prints")
    forest = components(links(distinct, radius), "a", "b").withColumnRenamed("node", "fingerprint")
    rooted = publish(
        distinct.join(forest, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint")), "rooted"
    )
    least = publish(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    # Only prints that are linked need the second table's answer.
    of_print = publish(rooted.join(least, "root").select("fingerprint", "component_id", "rows"), "print-components")
    # Rows of a print that very many texts share (all empty ones, say) are answered where they are.
    return lookup_join(prints, of_print, "fingerprint", "inner", weight="rows").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the row with the least ``doc_id``.

    Rows that repeat a ``doc_id`` count as copies of one document, of which any one stays.
    Rows without ``doc_id`` cannot be told apart and all stay.
    """
    counted = near_duplicates(docs, radius).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.col("doc_id") == F.col("component_id")).alias("first")
    )
    kept = publish(counted.where("first").drop("first"), "kept")
    # Texts are dealt by id once, at every size alike (ids of what is kept grow with the input and are
    # never broadcast); the second join reads the same shuffle and has the repeated ids only.
    single, repeated = (kept.where(w).select("doc_id").hint("shuffle_hash") for w in ("rows = 1", "rows > 1"))
    once = docs.join(single, "doc_id", "left_semi")
    again = docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    parts = [once, again, docs.where("doc_id IS NULL")]
    return parts[0].select(*docs.columns).unionByName(parts[1].select(*docs.columns)).unionByName(parts[2])

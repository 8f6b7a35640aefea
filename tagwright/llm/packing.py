"""Best-fit packing planned on a histogram of lengths.

Documents become pieces of at most ``capacity`` tokens. How many pieces there are of each length is
a table of at most ``capacity`` rows; best fit over these counts gives a plan of at most
``capacity`` patterns (each uses up some length). A piece then takes the slot that the plan has for
its rank within its length. No piece is compared with another, and no length meets in one task: a
piece's rank is its rank within its task plus the pieces of that length in the tasks before.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagwright.llm.tokens import library_encoder
from tagwright.operators.lookup import lookup_join
from tagwright.sources.shared import publish

CAPACITY = 1024
# Rows of an Arrow batch that are Python strings at a time.
ROWS_AT_ONCE = 1000

PIECES = "part int, local_rank long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, remembered: int = 200_000, chars: int = 4_000_000
) -> DataFrame:
    """One row per piece of every document: ids of the whole text and the end id, cut into pieces of
    ``capacity`` of which the first may be shorter. A null text counts as empty (one end id).

    ``part`` and ``local_rank`` number the pieces of a length within a task, in the order read.
    ``remembered`` (results kept by the encoder) and ``chars`` (encoded at once) weigh a task's memory
    against its time; the ids do not depend on them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = library_encoder(tokenizer, limit=remembered), {}, TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, ids, counts in encoder.batches(texts, chars):
                rows, stops = [], np.cumsum(counts)
                for i, (stop, count) in enumerate(zip(stops.tolist(), counts.tolist())):
                    doc = np.concatenate([ids[stop - count : stop], end])
                    first = len(doc) % capacity or capacity
                    for piece, start in enumerate([0, *range(first, len(doc), capacity)]):
                        length = first if piece == 0 else capacity
                        rank = seen.get(length, 0)
                        seen[length] = rank + 1
                        crc = zlib.crc32(doc[start : start + length].tobytes())
                        rows.append((part, rank, keys[at + i], piece, start, length, crc))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]
                yield pa.RecordBatch.from_arrays(columns, _NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


_NAMES = [c.split()[0] for c in PIECES.split(", ")]
_TYPES = [pa.int32() if c.endswith("int") else pa.int64() for c in PIECES.split(", ")]


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots for ``counts`` pieces of each length, and the number of sequences.

    Repeatedly: open a sequence with the longest length left, then add the longest that still fits
    (the best fit for the gap) until none does; repeat that pattern as often as the counts allow.
    A slot row ``(length, first_rank, per_sequence, first_sequence, offset)`` says that pieces of the
    length with ranks from ``first_rank`` up fill ``per_sequence`` places from ``offset`` on in each
    sequence from ``first_sequence`` up, until the length's next row.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    order, used, slots, sequences = sorted(left), dict.fromkeys(left, 0), [], 0
    while order:
        pattern, gap = [], capacity
        while True:
            # Lengths in the pattern already may be spent; look below until one is not.
            at = bisect_right(order, gap) - 1
            while at >= 0 and left[order[at]] <= sum(n for length, n in pattern if length == order[at]):
                at -= 1
            if at < 0:
                break
            length = order[at]
            fits = min(gap // length, left[length])
            pattern.append((length, fits))
            gap -= fits * length
        repeat = min(left[length] // n for length, n in pattern)
        offset = 0
        for length, n in pattern:
            slots.append((length, used[length], n, sequences, offset))
            used[length] += n * repeat
            left[length] -= n * repeat
            offset += n * length
        order = [n for n in order if left[n]]
        sequences += repeat
    return slots, sequences


def _placed(ranked: DataFrame, slots: Sequence[tuple[int, int, int, int, int]]) -> DataFrame:
    """Each piece with its sequence and offset. The slots travel with the task: their number is
    bounded by the capacity alone."""
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    span = int(table[:, 1].max()) + 1 if len(table) else 1
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = table[:, 0] * span + table[:, 1]
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(starts, length * span + np.minimum(rank, span - 1), side="right") - 1]
            place = rank - row[:, 1]
            sequence = row[:, 3] + place // row[:, 2]
            offset = row[:, 4] + place % row[:, 2] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*columns[:5], "sequence_id", "offset"]
            )

    return ranked.select(*columns).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, remembered: int = 200_000, chars: int = 4_000_000
) -> DataFrame:
    """Every piece of every document with its place: ``sequence_id`` and ``offset``.

    Repeated rows are packed each; an empty table gives no rows; columns other than ``doc_id`` and
    ``text`` are not read. The pieces (numbers, no ids) are written once, so every later step sees
    the same ranks whatever tasks are repeated. ``remembered`` and ``chars`` are those of ``pieces``.
    """
    found = publish(pieces(docs, tokenizer, end_id, capacity, remembered, chars), "pieces")
    by_part = publish(found.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("n")).collect()}
    slots, _ = best_fit_plan(counts, capacity)
    # The window holds a row for each task that read documents, not for each piece.
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = publish(
        by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "ranks"
    )
    # It grows with tasks times lengths, so it is broadcast only while it is measured to be small.
    ranked = lookup_join(found, before, ["part", "length"], "inner").withColumn("rank", F.col("before") + F.col("local_rank"))
    return _placed(ranked, slots)

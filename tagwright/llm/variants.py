"""Spelling variants by a dictionary of trie-node pairs.

The nodes of the trie over all words are numbered, and so are those of the trie over the reversed
words. A word cut at a position is then a pair of integers: the node of what stands before, the node
of what stands behind. Words that have a pair in common after skipping one code point differ by a
replacement there; a word whose plain cut has the pair of another's skip is that word with the code
point deleted. So exact neighbours at distance one are equal integer pairs: no candidate is verified
and no signature of letters is made. A pair holds at most a word per code point of the alphabet and
one word that lacks it, and neighbours are summed within it without listing them two by two.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwright.operators.lookup import lookup_join
from tagwright.sources.shared import publish

# Node numbers that a task holds before it hands them on.
BATCH = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(text: Column, least: int = 1) -> Column:
    """The maximal runs of at least ``least`` Latin-1 letters, A-Z lower-cased; none for null."""
    found = F.regexp_extract_all(text, F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda w: F.translate(w, UPPER, LOWER))


def counted(words: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """``(word, n)`` of the words of at least ``least_length`` code points that occur at least
    ``least_count`` times in column ``word``."""
    long = words.where(F.char_length("word") >= least_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


# ---- numbering trie nodes ---------------------------------------------------------------------


def _shared(a: str, b: str) -> int:
    """How many code points two words have in common from the start."""
    return sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(a, b)))


def _walk(words: Iterator[tuple]) -> Iterator[tuple]:
    """``(part, rank, nodes, start, *row)`` for rows ``(part, key, ...)`` sorted by part and key.

    ``nodes`` holds the number of every prefix, the empty one's 0 first. Numbers count new nodes
    within the part, so those of its first word are its depths; ``start`` says that a part starts.
    """
    part, last, nodes, made, rank = None, "", [0], 0, 0
    for row in words:
        start = row[0] != part
        if start:
            part, last, nodes, made, rank = row[0], "", [0], 0, 0
        key = row[1]
        same = _shared(last, key)
        new = len(key) - same
        nodes = nodes[: same + 1] + list(range(made + 1, made + new + 1))
        made += new
        rank += 1
        last = key
        yield part, rank, nodes, start, *row[1:]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def trie_nodes(words: DataFrame, key: str) -> DataFrame:
    """``words`` (``key`` unique) with ``rank``, their place in code-point order from 1, and ``nodes``,
    the numbers of the trie nodes of all their prefixes, from the root (0) on.

    Words are range-partitioned and written. A node is new at the first word in order that has it,
    which the word before tells. Each part numbers its own nodes; what its first word shares with the
    part before is settled from one row per part, the only rows that meet on the driver.
    """
    ranged = publish(words.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "trie-words")
    others = [c for c in words.columns if c != key]
    dealt = ranged.repartition("_part").sortWithinPartitions("_part", key).select("_part", key, *others)
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = []
        for part, rank, nodes, start, word, *_ in _walk(_rows(batches)):
            if start:
                found.append([part, word, word, nodes, rank, 0])
            found[-1][2:5] = [word, nodes, rank]
            found[-1][5] = max(found[-1][5], nodes[-1])
        if found:
            types = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            names = ["part", "first", "last", "nodes", "words", "made"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

    ends = dealt.mapInArrow(summed, "part int, first string, last string, nodes array<long>, words long, made long")
    before: dict[int, tuple[int, int, list[int]]] = {}  # part: words before, nodes before, numbers carried over
    rows, made, last, path = 0, 0, "", [0]
    for part, first, final, nodes, n_words, n_made in sorted(map(tuple, ends.collect())):
        carried = path[: _shared(last, first) + 1]
        before[part] = (rows, made - len(carried) + 1, carried)
        path = [carried[x] if x < len(carried) else x + before[part][1] for x in nodes]
        rows, made, last = rows + n_words, before[part][1] + n_made, final

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        numbers = 0
        for part, rank, nodes, _, *row in _walk(_rows(batches)):
            earlier, offset, carried = before[part]
            shared = len(carried)
            held.append((*row, rank + earlier, [carried[x] if x < shared else x + offset for x in nodes]))
            numbers += len(nodes)
            if numbers >= BATCH:
                yield batch(held)
                held, numbers = [], 0
        if held:
            yield batch(held)

    kinds = {"string": pa.string(), "bigint": pa.int64()}
    fields = [(f, t) for f, t in ranged.select(key, *others).dtypes]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [*[kinds[t] for _, t in fields], pa.int64(), pa.list_(pa.int64())]
        names = [*[f for f, _ in fields], "rank", "nodes"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    schema = T.StructType([ranged.schema[f] for f, _ in fields])
    return dealt.mapInArrow(run, schema.add("rank", "long").add("nodes", T.ArrayType(T.LongType())))


# ---- neighbours -------------------------------------------------------------------------------


def node_pairs(words: DataFrame) -> DataFrame:
    """``(before, behind, n, rank, skips, first)``: the pairs of every cut of ``words`` (``word, n,
    rank, nodes, tail_nodes``), with one code point skipped or with none.

    ``first`` is false where the skipped code point equals the one before it: deleting either gives
    the same word, which is to be found once.
    """
    size = F.size("nodes") - 1
    letters = F.split("word", "")
    ahead = lambda i: F.get(F.col("nodes"), i)
    behind = lambda i: F.get(F.col("tail_nodes"), size - i)

    def cut(i: Column, skip: int, first: Column) -> Column:
        return F.struct(
            ahead(i).alias("before"), behind(i + skip).alias("behind"), F.lit(skip == 1).alias("skips"), first.alias("first")
        )

    def cuts(letter: Column) -> Column:
        new = lambda i: (i == 0) | (F.get(letter, i) != F.get(letter, i - 1))
        skipped = F.transform(F.sequence(F.lit(0), size - 1), lambda i: cut(i, 1, new(i)))
        plain = F.transform(F.sequence(F.lit(0), size), lambda i: cut(i, 0, F.lit(True)))
        return F.concat(skipped, plain)

    every = F.flatten(F.transform(F.array(letters), cuts))
    return words.select("rank", "n", F.explode(every).alias("c")).select("c.*", "rank", "n")


def neighbours(pairs: DataFrame) -> DataFrame:
    """``(rank, n_near, near_n, near)``: for every word with a neighbour their number, and the most
    frequent of them (ties: the first in code-point order)."""
    member = F.struct((-F.col("n")).alias("m"), "rank", "skips", "first")
    met = pairs.groupBy("before", "behind").agg(F.sort_array(F.collect_list(member)).alias("members"))
    each = met.where(F.size("members") > 1).select("members", F.explode("members").alias("own"))
    own = F.col("own")

    def near(x: Column) -> Column:
        return F.when(x["skips"], (own["skips"] & (x["rank"] != own["rank"])) | (~own["skips"] & x["first"])).otherwise(
            own["skips"] & own["first"]
        )

    found = each.select(own["rank"].alias("rank"), F.filter("members", near).alias("near")).where(F.size("near") > 0)
    best = F.get("near", F.lit(0))
    rows = found.select("rank", F.size("near").cast("long").alias("k"), F.struct(best["m"].alias("m"), best["rank"].alias("rank")).alias("b"))
    summed = rows.groupBy("rank").agg(F.sum("k").alias("n_near"), F.min("b").alias("b"))
    return summed.select("rank", "n_near", (-F.col("b.m")).alias("near_n"), F.col("b.rank").alias("near"))


def roots(links: DataFrame) -> DataFrame:
    """``(rank, root)`` for links ``(rank, form)`` that never lead in a circle: the end of each one's
    chain, by doubling the way until nothing changes."""
    at = publish(links.select("rank", F.col("form").alias("root")), "chains")
    while True:
        further = at.select(F.col("rank").alias("root"), F.col("root").alias("end"))
        moved = lookup_join(at, further, "root").select("rank", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved"))
        moved = publish(moved, "chains")
        if moved.where("moved").isEmpty():
            return moved.select("rank", "root")
        at = moved.select("rank", "root")


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for every row of ``words`` (``word`` unique, with its
    count ``n``; neither null).

    Near words differ by one inserted, deleted or replaced code point. A word's form is its near word
    of largest ``n`` (ties: smallest in code-point order) if that is at least ``ratio`` (over 1) times
    its own; ``root`` follows forms to the last. Words may be of any length: a word costs as many
    integers as it has code points. No words, no rows.
    """
    forward = publish(trie_nodes(words.select("word", F.col("n").cast("long").alias("n")), "word"), "forward")
    reverse = trie_nodes(forward.select(F.reverse("word").alias("tail"), F.col("rank").alias("id")), "tail")
    tails = publish(reverse.select(F.col("id").alias("rank"), F.col("nodes").alias("tail_nodes")), "backward")
    near = publish(neighbours(node_pairs(forward.join(tails, "rank"))), "near")

    known = forward.select("rank", "word", "n")
    links = publish(
        near.join(known.select("rank", "n"), "rank").where(F.col("near_n") >= ratio * F.col("n")).select(
            "rank", F.col("near").alias("form"), F.col("near_n").alias("form_n")
        ),
        "links",
    )
    named = lambda c: known.select(F.col("rank").alias(c), F.col("word").alias(f"{c}_word"))
    ends = links.join(roots(links), "rank")
    spelled = lookup_join(lookup_join(ends, named("form"), "form"), named("root"), "root")
    spelled = publish(spelled.select("rank", "form_n", F.col("form_word").alias("form"), F.col("root_word").alias("root")), "spelled")
    return known.join(near.select("rank", "n_near"), "rank", "left").join(spelled, "rank", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n",
        F.coalesce("root", "word").alias("root"),
    )

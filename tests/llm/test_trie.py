"""The prefix trie of conversations against its definition."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from tagwright.llm import prefix_trie
from tagwright.llm.queries import op11_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def asked(spark, tmp_path, rows):
    """The query over a table of these rows, with columns that could clash."""
    table = spark.createDataFrame(rows, SCHEMA)
    clashing = "path chars depth family head node parent n_convs ends top floor at a b n".split()
    folder = str(tmp_path / "tables")
    table.withColumns({c: F.lit(7) for c in clashing}).write.parquet(f"{folder}/conversations.parquet")
    got = [tuple(r) for r in op11_prefix_trie(spark, folder).collect()]
    assert len(set(got)) == len(got)
    return set(got)


ODD = [
    (5, None, None, None),  # nulls
    (5, 1, "user", ""),
    (None, 0, "user", "nobody's"),
    (None, 1, "user", "nobody's"),
    (7, 3, "user", "x" * 1_200_000),  # long
    (7, 2, None, "é\U0001f600"),
    (-3, 1, "user", "below zero"),
    (-100, 1, "user", "family of -3"),
    (-100, 2, "user", "more"),
    (300, 0, "a", "b"),
    (301, 0, "ab", ""),  # a role and text that run together alike
    (302, 0, "user", "twice"),  # repeated rows are turns each
    (302, 0, "user", "twice"),
    (1417, 0, "user", "without a family"),
]


def test_odd_conversations(spark, tmp_path):
    assert asked(spark, tmp_path, ODD) == brute.trie(brute.rebuilt(ODD))


def test_empty(spark, tmp_path):
    assert asked(spark, tmp_path, []) == set()


def test_ties_have_one_result(spark):
    rows = [(1, 0, "b", "x"), (1, 0, "a", "y"), (1, 0, "a", "x"), (2, 0, "a", "x"), (2, 0, "b", "x"), (2, 0, "a", "y")]
    found = [
        spark.createDataFrame(r, SCHEMA).repartition(3).transform(prefix_trie.paths).select("path").distinct().collect()
        for r in (rows, rows[::-1])
    ]
    assert found[0] == found[1] and len(found[0]) == 1


def crowd(seed, n=300, deep=70):
    """Few texts, so that much is shared; copies; some long ones, alike for most of their length."""
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(2000), n):
        kind = rnd.random()
        if kind < 0.3:
            turns = [("user", "hello"), ("assistant", "hi")]
        elif kind < 0.4:
            turns = [("user", f"t{i % 3}") for i in range(rnd.randrange(deep - 5, deep))]
        else:
            turns = [(rnd.choice("ua"), rnd.choice("xyz")) for _ in range(rnd.randrange(1, 9))]
        rows += [(c, i, role, text) for i, (role, text) in enumerate(turns)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("group", [1, 40, 2048])
def test_any_stride_gives_the_same_trie(spark, group):
    """From level by level to all levels but the root at once."""
    deep = 12 if group == 1 else 70
    rows = crowd(group, deep=deep)
    whole = {}
    for c, i, role, text in sorted(rows):
        whole.setdefault(c, []).append((role, text))
    records = prefix_trie.paths(spark.createDataFrame(rows, SCHEMA))
    got = {tuple(r) for r in prefix_trie.trie(records, group).collect()}
    assert got == brute.trie(whole)


def test_families(spark, tmp_path):
    rows = crowd(9)
    assert asked(spark, tmp_path, rows) == brute.trie(brute.rebuilt(rows))


def test_ids_of_many_copies_are_digested_in_order(spark):
    ids = [*range(-9000, 9000, 2), 1 << 40]
    table = spark.createDataFrame([(c, 0, "user", "same") for c in ids], SCHEMA).repartition(5)
    got = {tuple(r) for r in prefix_trie.trie(prefix_trie.paths(table)).collect()}
    assert got == brute.trie({c: [("user", "same")] for c in ids})

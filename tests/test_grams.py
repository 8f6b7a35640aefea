"""Runs of words, hashed by Arrow batches, against the definition in plain Python."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagwright.functions import text as tx
from tagwright.operators import grams, sparse
from tagwright.plans import features

TEXTS = ["red car and red car", "", None, "x", "Blue  blue\tblue blue-green", "ééé straße 12 12", "long " * 700 + "end"]


def expected(words, how):
    found = defaultdict(list)
    for n, weight in enumerate(how.weights):
        for i in range(len(words) - n):
            digest = hashlib.md5(" ".join(words[i : i + n + 1]).encode()).digest()
            sign = -1 if how.signed and digest[4] % 2 else 1
            found[int.from_bytes(digest[:4], "big") % how.buckets].append(sign * weight)
    cells = {k: max(v) if how.combine == "max" else sum(v) for k, v in found.items()}
    cells = {k: v for k, v in cells.items() if v}
    length = sum(v * v for v in cells.values()) ** 0.5 if how.l2 else 1.0
    return {k: v / length for k, v in cells.items()}


@pytest.mark.parametrize("how", [
    grams.Hashing((1.0, 1.0, 1.0), 1 << 27, l2=True),
    grams.Hashing((1.5, 1.0), 1 << 29, combine="max"),
    grams.Hashing((1.0, 1.0), 7, signed=True, l2=True),
    grams.Hashing((1.0,), 1 << 32),
])
def test_cells_are_the_definition(how, monkeypatch):
    monkeypatch.setattr(grams, "REMEMBERED", 3)
    texts = [" ".join(t.split()) if t is not None else None for t in TEXTS]
    row, bucket, value = grams.cells(texts, how, grams.Prints())
    for i, text in enumerate(texts):
        at = row == i
        assert dict(zip(bucket[at].tolist(), value[at].tolist())) == pytest.approx(expected((text or "").split(), how))
    assert [len(x) for x in grams.cells([], how, grams.Prints())] == [0, 0, 0]


def test_runs_of_rows_cover_all_rows():
    texts = ["a" * 10, None, "b" * 500, "", "c" * 3]
    assert list(grams.runs_of_rows(texts, 100)) == [(0, 3), (3, 5)]
    assert list(grams.runs_of_rows([], 100)) == []


def test_blocks_of_words_and_others_come_from_one_pass(spark):
    df = spark.createDataFrame([(str(i), t, i) for i, t in enumerate(TEXTS)], "listing_id string, t string, k int")
    words = sparse.hash_vectorize("desc", F.col("t"), 2, buckets=11, signed=True)
    both = sparse.stack_blocks(df, [sparse.onehot("k", F.col("k")), words, sparse.count_category_words("w", F.col("t"))], carry=["k"])
    assert both.columns == ["listing_id", "k", "block", "feature", "value"]
    got = defaultdict(dict)
    for r in both.collect():
        assert r["listing_id"] == str(r["k"]) and r["feature"] not in got[r["block"], r["k"]]
        got[r["block"], r["k"]][r["feature"]] = r["value"]
    kept = [[w for w in r[0] or [] if w not in ("the", "a", "an", "is", "it", "this")] for r in df.orderBy("k").select(tx.words_of_two(F.col("t"), lowercase=False)).collect()]
    for i, own in enumerate(kept):
        assert got["k", i] == {str(i): 1.0}
        assert {int(k): v for k, v in got["desc", i].items()} == pytest.approx(expected(own, words.hashing))
    assert got["w", 4] == {"blue": 4.0, "green": 1.0} and got["w", 1] == {}


def test_no_array_is_copied_for_each_of_its_elements(spark):
    """A slice inside a lambda copies its whole array, so long texts cost the square of their words."""
    df = spark.createDataFrame([("0", "a b")], "listing_id string, t string")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    for block in (sparse.wordbag_desc(F.col("t")), sparse.hash_vectorize("d", F.col("t"), 3)):
        found = plan(sparse.stack_blocks(df, [block]))
        assert "MapInArrow" in found and "slice(" not in found and "md5(" not in found
    assert "slice(" not in plan(sparse.stack_blocks(df, [sparse.count_category_words("w", F.col("t"))]))
    assert "slice(" not in plan(df.select(tx.ngrams(tx.tokenize_words(F.col("t")), 3)))


def test_words_are_runs_of_their_characters(spark):
    df = spark.createDataFrame([(t,) for t in ["A bc, D-EF_g 1 22 the", "", None, " ÉK9 ıİx "]], "t string")
    rows = df.select(tx.normalized_words(F.col("t")), tx.tokenize_words(F.col("t"))).collect()
    assert [r[0] for r in rows] == [["bc", "ef", "22"], [], None, []]
    assert rows[0][1] == ["a", "bc", "d", "ef_g", "1", "22", "the"] and rows[1][1] == [] and rows[2][1] is None


def test_signs_cancel_without_a_division_by_zero():
    how = grams.Hashing((1.0,), 1, signed=True, l2=True)
    words = [f"w{i}" for i in range(40)]
    signs = {w: hashlib.md5(w.encode()).digest()[4] % 2 for w in words}
    pair = [next(w for w in words if signs[w]), next(w for w in words if not signs[w])]
    assert [len(x) for x in grams.cells([" ".join(pair)], how, grams.Prints())] == [0, 0, 0]
    row, _, value = grams.cells([" ".join(pair), pair[0]], how, grams.Prints())
    assert np.array_equal(row, [1]) and value[0] == -1.0


def test_digests_are_computed_together(monkeypatch):
    """Only grams longer than one block of md5 cost a call each."""
    called = []
    monkeypatch.setattr(grams, "md5", lambda x, **more: called.append(x) or hashlib.md5(x, **more))
    texts = ["é" * 27 + "x", "é" * 28, *["y" * n for n in (1, 3, 4, 5, 54, 55, 56, 57, 63, 64, 200)], "a b " * 9000 + "c"]
    row, bucket, _ = grams.cells(texts, grams.Hashing((1.0,), 1 << 32), grams.Prints())
    assert sorted(map(len, called)) == [56, 56, 57, 63, 64, 200]
    for i, text in enumerate(texts):
        words = {int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") for w in text.split()}
        assert set(bucket[row == i].tolist()) == words


def test_grams_of_many_sizes_share_few_masked_words(monkeypatch):
    """Digests are computed by size: a word that all grams of a chunk fill is taken as it is. Cells are
    sorted with their values, so equal cells of several weights and signs still add up."""
    masked = []
    clip = np.clip
    monkeypatch.setattr(np, "clip", lambda *a, **more: masked.append(1) or clip(*a, **more))
    monkeypatch.setattr(grams, "TOGETHER", 10)
    texts = [" ".join("abcdefgh"[i % 8] * (i % 50 + 1) for i in range(200)), "aa bb aa bb aa cc"]
    for how in (grams.Hashing((1.0,), 1 << 32), grams.Hashing((1.5, 0.25, 3.0), 5, signed=True), grams.Hashing((0.0, 1.0), 1 << 20)):
        masked.clear()
        row, bucket, value = grams.cells(texts, how, grams.Prints())
        for i, text in enumerate(texts):
            found = dict(zip(bucket[row == i].tolist(), value[row == i].tolist()))
            assert found == pytest.approx(expected(text.split(), how))
        if len(how.weights) == 1:
            assert len(masked) <= 2 * 21  # 21 chunks of neighbouring sizes


def test_rounding_is_that_of_decimals(spark):
    rng = np.random.default_rng(3)
    values = [0.0, -0.0, 1 / 128, -1 / 128, 0.1234565, 0.1234575, 2.5e-6, -1e-9, 1e15, -1e300, 1e9 + 0.5, 5e-7, float("nan"), float("inf"), None]
    values += (rng.normal(0, 1, 5000) ** 3).tolist() + (1 / np.sqrt(np.arange(1, 5000))).tolist() + ((rng.integers(0, 10**7, 5000) + 0.5) / 1e6).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6).alias("a"), tx.rounded(F.col("v"), 6).alias("b"))
    assert [r for r in df.collect() if repr(r["a"]) != repr(r["b"])] == []
    plan = sparse.stack_blocks(spark.createDataFrame([("0", "a b")], "listing_id string, t string"), [sparse.wordbag_desc(F.col("t"))])
    assert "CASE WHEN" in features.out_features(plan)._jdf.queryExecution().optimizedPlan().toString()


def test_lone_cells_are_neither_sorted_nor_combined(spark):
    df = spark.createDataFrame([("0", "a", 2.0), ("1", None, 0.0), ("2", "", None)], "listing_id string, t string, v double")
    blocks = [sparse.onehot("o", F.col("t")), sparse.numeric("n", F.col("v")), sparse.count_whole_value("w", F.col("t"))]
    found = sparse.stack_blocks(df, blocks)
    assert sorted(map(tuple, found.collect())) == [("0", "n", "n", 2.0), ("0", "o", "a", 1.0), ("0", "w", "a", 1.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" not in plan and "aggregate(" not in plan

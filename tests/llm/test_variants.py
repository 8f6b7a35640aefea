"""Spelling variants against comparing every word with every other."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from tagwright.llm import variants
from tagwright.llm.queries import op12_spelling_variants


@pytest.fixture
def many_parts(spark):
    """Small tables keep their parts, so that tries are numbered across several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def table(spark, words):
    rows = list(words.items())
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "word string, n long")


def same(df, want):
    got = [tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("seed", range(3))
def test_neighbours_of_crowded_words(spark, many_parts, seed):
    """Two letters only: long runs of one letter, many neighbours, ties, chains of forms."""
    rnd = random.Random(seed)
    words = {"".join(rnd.choice("aaab") for _ in range(rnd.randrange(1, 9))): rnd.choice([1, 5, 5, 30, 200, 1000]) for _ in range(150)}
    same(variants.variants(table(spark, words)), brute.spelled(words))


def test_words_of_any_script_and_length(spark, many_parts):
    long = "".join(random.Random(1).choices("xyz", k=60_000))
    words = {long: 100, long[:500] + long[501:]: 7, "é" + long[1:]: 1, "strasse": 50, "straße": 10, "naïve": 5, "naive": 25}
    words |= {"\U0001f600a": 1, "\U0001f600": 9, "日本": 3, "日本語": 15, "ab": 4, "abc": 20, "abcd": 100, "abcde": 500, "a": 1}
    small = {w: n for w, n in words.items() if len(w) < 100}
    want = brute.spelled(small) | {
        (long, 100, 2, None, None, long),
        (long[:500] + long[501:], 7, 1, long, 100, long),
        ("é" + long[1:], 1, 1, long, 100, long),
    }
    same(variants.variants(table(spark, words)), want)


def test_no_words(spark):
    assert variants.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_numbers_of_nodes(spark, many_parts):
    """Every distinct prefix has one number, from 0 without gaps, and every word its rank."""
    words = sorted({"".join(random.Random(i).choices("abc", k=i % 7 + 1)) for i in range(400)})
    found = variants.trie_nodes(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()
    assert sorted((r["rank"], r.w) for r in found) == list(enumerate(words, 1))
    numbers = {}
    for r in found:
        for i, x in enumerate(r.nodes):
            assert numbers.setdefault(r.w[:i], x) == x
    assert sorted(numbers.values()) == list(range(len(numbers)))


def test_query_on_whole_documents(spark, docs, texts, tmp_path):
    """Odd documents too: nulls, empty and long texts, clashing columns, rows that repeat."""
    more = [(-50, "Wordless × ÷ÀÉÎõü " * 5 + "ÀÉÎÕÜ × ÷àéîõü " * 6), (None, "nobody nobody NOBODY nobody's nobody"), (-51, "z" * 1_100_000)]
    extra = spark.createDataFrame(more, "doc_id long, text string")
    every = docs.unionByName(extra, allowMissingColumns=True).unionByName(extra, allowMissingColumns=True)
    folder = str(tmp_path / "tables")
    every.withColumns({c: F.lit(7) for c in ("word", "run", "key", "n", "rank")}).write.parquet(f"{folder}/documents.parquet")
    words = brute.dictionary([*texts.items(), *more, *more])
    same(op12_spelling_variants(spark, folder), brute.spelled(words))

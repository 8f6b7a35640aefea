"""Cells that stay in their listing's row give what the long table gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagwright.operators import packed, sparse
from tagwright.sources.shared import publish


@pytest.fixture(scope="module")
def docs(spark):
    texts = [" ".join(f"w{(i * j) % 17}" for j in range(1 + i % 9)) for i in range(60)]
    rows = [(str(i), t, "en" if i % 3 else "de") for i, t in enumerate(texts)]
    rows += [("7", "w1 w2 again", "en"), ("8", None, None), (None, "w1 w2 w3", "en"), (None, "w3 w3", "fr"), ("60", "", None)]
    return publish(spark.createDataFrame(rows, "listing_id string, t string, lang string").repartition(3), "docs")


ALONE = "listing_id not in ('7', '8')"


def both(docs):
    blocks = [
        sparse.hash_vectorize("desc", F.col("t"), 2), sparse.onehot("lang", F.col("lang")),
        sparse.hash_vectorize("signed", F.col("t"), 3, buckets=5, signed=True),
    ]
    return tuple(publish(sparse.stack_blocks(docs, blocks, by_row=x), "f") for x in (False, True))


def rows_of(df):
    return sorted((str(r[0]), r[1], r[2], round(r[3], 9)) for r in df.select("listing_id", "block", "feature", "value").collect())


@pytest.mark.parametrize("most", [packed.MOST_BYTES, 0])
def test_filter_and_weights_by_row_are_those_of_the_long_table(docs, monkeypatch, most):
    monkeypatch.setattr(packed, "MOST_BYTES", most)
    long, stacked = both(docs)
    assert rows_of(sparse.unstacked(stacked)) == rows_of(long)
    nnz = publish(sparse.col_nnz(long), "nnz")
    assert sorted(sparse.col_nnz(stacked).collect()) == sorted(nnz.collect())
    kept = nnz.where("df between 3 and 30")
    assert rows_of(sparse.df_filter(stacked, kept)) == rows_of(sparse.df_filter(long, kept))
    for table in (nnz, kept):
        assert rows_of(sparse.tfidf(stacked, table, docs)) == rows_of(sparse.tfidf(long, table, docs))


def test_no_cell_of_a_row_is_shuffled(docs):
    _, stacked = both(docs.where(ALONE))
    nnz = publish(sparse.col_nnz(stacked), "nnz")
    for found in (sparse.tfidf(stacked, nnz, docs), sparse.df_filter(stacked, nnz)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "hashpartitioning" not in plan


def test_counts_are_added_up_in_tasks_and_by_ranges(spark, docs, monkeypatch):
    monkeypatch.setattr(packed, "RANGE", 1 << 10)
    monkeypatch.setattr(packed, "HELD", 20)
    long, stacked = both(docs.withColumn("split", F.lit("train")))
    assert sorted(sparse.col_nnz(stacked).collect()) == sorted(sparse.col_nnz(long).collect())


@pytest.mark.parametrize("wide", [300, 1 << 20])
def test_fitted_counts_answer_any_bucket(spark, wide):
    rng = np.random.default_rng(1)
    keys = rng.choice(wide, 200, replace=False)
    counts = rng.choice([1, 2, 254, 255, 256, 70_000], 200)
    rows = [("b", str(k), int(n)) for k, n in zip(keys, counts)] + [("b", "x1", 3), ("b", "007", 3), ("c", "5", 9)]
    found = packed.fitted_counts(spark.createDataFrame(rows, "block string, feature string, df long"), "b")
    want = np.zeros(wide + 10, np.int64)
    want[keys] = counts
    assert found.of(np.arange(wide + 10)).tolist() == want.tolist()
    assert (found.listed is None) == (wide == 300)
    nothing = packed.fitted_counts(spark.createDataFrame([], "block string, feature string, df long"), "b")
    assert nothing.of(np.array([0, 5])).tolist() == [0, 0]


@pytest.mark.parametrize("wide", [1, 9, 10, 11, 100, 1234, 20_005])
def test_numbers_are_placed_in_the_order_of_their_texts(wide):
    order = sorted(range(wide), key=str)
    assert packed.text_rank(np.array(order), wide).tolist() == list(range(wide))


def test_many_features_are_placed_without_a_join(spark, docs, monkeypatch):
    """More features than are sent with their numbers: a bit each tells their place, and no cell is moved. Indices
    in any other order are joined."""
    long, stacked = both(docs.where(ALONE))
    index = publish(sparse.feature_index(sparse.kept_features(sparse.col_nnz(long), 2)), "index")
    want = {r[0]: r["features"] for r in sparse.to_vectors(long, index, docs.where(ALONE)).collect()}
    monkeypatch.setattr(sparse, "PLACES", 0)
    turned = index.withColumn("index", F.lit(index.count() - 1) - F.col("index"))
    assert packed.fitted_places(turned, "desc") is None
    assert packed.fitted_places(index.where("index % 7 <> 3"), "desc") is None
    joined, pack = [], sparse.pack_vectors
    monkeypatch.setattr(sparse, "pack_vectors", lambda *args: joined.append(1) or pack(*args))
    found = sparse.to_vectors(stacked, index, stacked)
    assert not joined and {r[0]: r["features"] for r in found.collect()} == want
    sparse.to_vectors(stacked, turned, stacked)
    assert joined

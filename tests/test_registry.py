"""Registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, canonical

DIR = "/root/testdata/sf0.001"
# The slower ones are covered by ``check.py``.
CHECKED = [
    "scan_listings_tsv", "fill_missing_dense", "enrich_name_desc", "topk_keep", "target_encode",
    "sequence_encode", "wordbag_desc", "df_filter", "tfidf", "brand_fill", "fuzzy_suggest",
    "stream_features", "stem_tokens",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    df = queries()[name](spark, DIR)
    want = con.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want.fetchall(), want.columns)


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert {r["split"] for r in rows} == {"train", "test"}
    assert all(r["means_rmsle"] < 2 * r["constant_rmsle"] for r in rows)


def test_dense_model_beats_the_constant(spark):
    from pyspark.sql import functions as F

    found = queries()["dense_price"](spark, DIR)
    from tagwright.plans import inputs

    actual = inputs.test(spark, DIR).select("listing_id", "price").withColumnRenamed("price", "actual")
    both = found.join(actual, "listing_id").where("actual > 0")
    guess = inputs.train(spark, DIR).agg(F.avg("log_price")).first()[0]
    row = both.agg(
        F.sqrt(F.avg(F.pow(F.log1p("price") - F.log1p("actual"), F.lit(2)))).alias("model"),
        F.sqrt(F.avg(F.pow(F.lit(guess) - F.log1p("actual"), F.lit(2)))).alias("constant"),
    ).first()
    assert row["model"] <= row["constant"] * 1.05

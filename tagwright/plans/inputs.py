"""The steps most queries start from; the SQL twins are in ``oracles.STEPS`` under the same names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.operators import clean
from tagwright.sources.fixtures import listings
from tagwright.sources.listings import is_test, is_train


def priced(spark: SparkSession, d: str) -> DataFrame:
    return clean.filter_zero_price(listings(spark, d))


def filled(spark: SparkSession, d: str) -> DataFrame:
    rows = clean.fill_missing_dense(priced(spark, d))
    return rows.withColumn("log_price", clean.log_price(F.col("price")))


def train(spark: SparkSession, d: str) -> DataFrame:
    return filled(spark, d).where(is_train())


def test(spark: SparkSession, d: str) -> DataFrame:
    return filled(spark, d).where(is_test())


def tagged(spark: SparkSession, d: str) -> DataFrame:
    return clean.fill_missing_tag(clean.with_categories(listings(spark, d)))


def lowered(spark: SparkSession, d: str) -> DataFrame:
    return clean.fill_empty_lower(clean.presence_flags(priced(spark, d)))


def unified(spark: SparkSession, d: str) -> DataFrame:
    return clean.normalize_units(lowered(spark, d))


def cats4(spark: SparkSession, d: str) -> DataFrame:
    return clean.with_categories4(unified(spark, d))

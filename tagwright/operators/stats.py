"""Means, frequencies and top lists per key.

Everything here is a ``groupBy`` with partial aggregation: a key holding a third of all rows
reaches the shuffle as one partial row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.operators.lookup import dense_index, fits, lookup_join
from tagwright.sources.shared import publish

ENCODED = {
    "category_name": "cat_mean",
    "item_condition_id": "cond_mean",
    "brand_name": "brand_mean",
    "shipping": "ship_mean",
}


def group_mean(df: DataFrame, key: str, target: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(target).alias(name), F.count(F.lit(1)).alias("n"))


def per_key(df: DataFrame, keys: Sequence[str], *measures: Column) -> DataFrame:
    """Measures for several keys from one scan and one shuffle: ``(feature, key, ...)``."""
    grouped = df.groupingSets([[k] for k in keys], *keys).agg(
        *measures, *[F.grouping(k).alias(f"_g_{k}") for k in keys]
    )
    feature = F.coalesce(*[F.when(F.col(f"_g_{k}") == 0, F.lit(k)) for k in keys])
    key = F.coalesce(*[F.when(F.col(f"_g_{k}") == 0, F.col(k)) for k in keys])
    rest = [c for c in grouped.columns if c not in keys and not c.startswith("_g_")]
    return grouped.select(feature.alias("feature"), key.alias("key"), *rest)


def group_means(df: DataFrame, target: str, keys: Sequence[str] = tuple(ENCODED)) -> DataFrame:
    """The means for several keys: ``(feature, key, mean, n)``."""
    named = df.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(target).alias("_y"))
    return per_key(named, keys, F.avg("_y").alias("mean"), F.count(F.lit(1)).alias("n"))


def smoothed_mean(df: DataFrame, key: str, target: str, name: str, alpha: float = 0.0) -> DataFrame:
    """``(sum + m * alpha) / (n + alpha)`` with m the mean of all rows."""
    overall = df.agg(F.avg(target).alias("m"))
    groups = df.groupBy(key).agg(F.sum(target).alias("_sum"), F.count(F.lit(1)).alias("n"))
    value = (F.col("_sum") + F.col("_m") * alpha) / (F.col("n") + F.lit(alpha))
    return groups.withColumn("_m", overall.scalar()).select(key, value.alias(name), "n")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, column: str, top: int, skip: str = "missing") -> DataFrame:
    """The ``top`` most frequent values but ``skip``; ties by value. A bounded top list."""
    counted = value_counts(df.where(F.col(column).isNotNull() & (F.col(column) != skip)), column)
    return counted.orderBy(F.desc("n"), F.asc(column)).limit(top)


def keep_values(
    df: DataFrame, kept: DataFrame, column: str, other: str = "missing", small: bool | None = None
) -> DataFrame:
    """Values outside the kept set become ``other``. ``kept`` holds ``n``, the rows of each value."""
    hits = kept.select(column, F.lit(True).alias("_hit"), F.col("n").alias("_n"))
    joined = lookup_join(df, hits, column, weight="_n", small=small)
    return joined.withColumn(column, F.when(F.col("_hit"), F.col(column)).otherwise(other)).drop("_hit", "_n")


def fit_tops(df: DataFrame, tops: dict[str, int], skip: str = "missing") -> DataFrame:
    """``(feature, key, n)``: the most frequent values of several columns, counted in one pass."""
    counts = publish(per_key(df.select(*tops), list(tops), F.count(F.lit(1)).alias("n")), "counts")
    wanted = counts.where(F.col("key").isNotNull() & (F.col("key") != skip))
    best = [
        wanted.where(F.col("feature") == column).orderBy(F.desc("n"), F.asc("key")).limit(top)
        for column, top in tops.items()
    ]
    return union_splits(*best)


def topk_keep(
    df: DataFrame, tops: dict[str, int], fit_on: DataFrame | None = None, skip: str = "missing"
) -> DataFrame:
    """Cut several columns to their most frequent values, counted on ``fit_on``."""
    kept = publish(fit_tops(df if fit_on is None else fit_on, tops, skip), "tops")
    small = fits(kept) or None
    for column in tops:
        one = kept.where(F.col("feature") == column).select(F.col("key").alias(column), "n")
        df = keep_values(df, one, column, skip, small)
    return df


# ---- tables that grow -------------------------------------------------------------------------

STATE = ["feature", "key", "total", "n", "least", "most"]


def partial_state(df: DataFrame, target: str, keys: Sequence[str] = tuple(ENCODED)) -> DataFrame:
    """What a chunk of rows adds to the fitted tables: sum, rows, least and most of ``target`` per value
    of every key, ``(feature, key, total, n, least, most)``."""
    named = df.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(target).alias("_y"))
    y = F.col("_y")
    return per_key(
        named, keys, F.sum(y).alias("total"), F.count(F.lit(1)).alias("n"), F.min(y).alias("least"), F.max(y).alias("most")
    ).select(*STATE)


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all rows together. Merging is associative and the order of chunks does not matter,
    so a fitted table grows by its chunks' states and no row is read twice."""
    return union_splits(*states).groupBy("feature", "key").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")
    )


def state_means(state: DataFrame) -> DataFrame:
    """``group_means`` of the rows behind a state."""
    return state.select("feature", "key", (F.col("total") / F.col("n")).alias("mean"), "n")


def state_counts(state: DataFrame, column: str) -> DataFrame:
    """``value_counts`` of one of the keys."""
    return state.where(F.col("feature") == column).select(F.col("key").alias(column), "n")


def state_range(state: DataFrame, column: str) -> DataFrame:
    """``min_max`` of the target, from the values of any one key."""
    return state.where(F.col("feature") == column).agg(F.min("least").alias("least"), F.max("most").alias("most"))


def min_count_index(df: DataFrame, column: str, minimum: int, skip: str) -> DataFrame:
    """``(value, n, idx)``: values seen at least ``minimum`` times, numbered from 1 in order."""
    counted = value_counts(df.where(F.col(column) != skip), column).where(F.col("n") >= minimum)
    return dense_index(counted, column, "idx")


def lookup_index(df: DataFrame, index: DataFrame, column: str, name: str = "idx") -> DataFrame:
    """The value's index, 0 for values without one."""
    pairs = index.select(column, F.col("idx").alias("_idx"), F.col("n").alias("_n"))
    joined = lookup_join(df, pairs, column, weight="_n")
    return joined.withColumn(name, F.coalesce("_idx", F.lit(0))).drop("_idx", "_n")


def global_moments(df: DataFrame, target: str) -> DataFrame:
    return df.agg(F.avg(target).alias("mean"), F.stddev_pop(target).alias("std"))


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with ``<column>_min`` and ``<column>_max``."""
    pairs = [(F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")) for c in columns]
    return df.agg(*[x for pair in pairs for x in pair])


def union_splits(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def scaled(column: Column, low: Column, high: Column) -> Column:
    """To [-1, 1] by the fitted range, unclipped; a constant column maps to -1."""
    width = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return (column - low) / width * 2.0 - 1.0

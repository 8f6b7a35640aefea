"""Joining fitted tables to big data, whatever the size of either and however skewed the keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwright.sources.shared import publish

# A table is broadcast only when its measured size stays below this; the session can set another
# limit, as executors with more memory broadcast a bigger vocabulary more cheaply than they shuffle.
BROADCAST_BYTES = 48 * 1024 * 1024
BROADCAST_SETTING = "spark.tagwright.broadcastBytes"


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_SETTING, str(BROADCAST_BYTES)))


def by_listing(df: DataFrame) -> DataFrame:
    """Rows placed by ``listing_id``; adaptive execution chooses how many partitions that takes."""
    return df.repartition("listing_id")


def _width(field: T.StructField) -> Column:
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType):
        if isinstance(field.dataType.elementType, T.StringType):
            return F.coalesce(F.octet_length(F.array_join(col, "")) + F.size(col) * 16, F.lit(0)) + 24
        return F.coalesce(F.size(col), F.lit(0)) * 8 + 24
    return F.lit(8)


def measured_bytes(table: DataFrame) -> int:
    """Upper estimate of the table's size in memory. Cheap on a published table."""
    width = sum((_width(f) for f in table.schema.fields), F.lit(48))
    return int(table.agg(F.coalesce(F.sum(width), F.lit(0)).cast("long")).first()[0])


def fits(table: DataFrame, limit_bytes: int | None = None) -> bool:
    """Whether the table may be broadcast."""
    limit = broadcast_limit(table.sparkSession) if limit_bytes is None else limit_bytes
    return measured_bytes(table) <= limit


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    weight: str | None = None,
    limit_bytes: int | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Join ``rows`` with a fitted ``table`` that holds each key once.

    ``how`` is ``left``, ``inner`` or ``left_semi``. A table measured below the limit (the session's,
    or ``limit_bytes``) is broadcast, so the big side is not shuffled. A bigger one is joined by
    shuffle. If ``weight`` names the table's column with the number of rows per key, the keys heavier
    than one shuffle partition's share are answered by broadcast (they are fewer than partitions)
    and their rows, like rows without a key, stay where they are; only the others are shuffled.

    ``rows`` is then read twice, so it should be a stored table or cheap. ``small`` is the answer of
    an earlier ``fits`` for this table, to save measuring it again.
    """
    on = [on] if isinstance(on, str) else list(on)
    if fits(table, limit_bytes) if small is None else small:
        keep = table.select(*on) if how == "left_semi" else table
        return rows.join(F.broadcast(keep), on, how)
    # Sizes of compressed files must not make the planner broadcast what was measured to be too big.
    if weight is None:
        return rows.join(table.hint("merge"), on, how)

    payload = [] if how == "left_semi" else [c for c in table.columns if c not in on]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = table.agg(F.sum(weight) / parts).scalar()
    hot = table.where(F.col(weight) > share).select(*on, *payload, F.lit(True).alias("_hot"))
    rest = [c for c in rows.columns if c not in on]
    keyless = F.lit(False)
    for key in on:
        keyless = keyless | F.col(key).isNull()
    columns = [*on, *rest, *payload]

    here = rows.join(F.broadcast(hot), on, "left")
    here = here.where((F.col("_hot") | keyless) if how == "left" else F.col("_hot"))
    others = rows.where(~keyless).join(F.broadcast(hot.select(*on)), on, "left_anti")
    return here.select(*columns).unionByName(others.join(table.select(*on, *payload).hint("merge"), on, how).select(*columns))


def dense_index(table: DataFrame, keys: str | Sequence[str], name: str, start: int = 1) -> DataFrame:
    """Number the rows of ``table`` (``keys`` unique) in key order, without one task seeing them all.

    Rows are range-partitioned and written with their partition number; each partition numbers its
    own rows and adds the rows before it. The only unpartitioned window runs over one row per
    partition.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    ranged = publish(
        table.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "index"
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return (
        ranged.withColumn("_rank", within)
        .join(F.broadcast(offsets), "_part")
        .select(*table.columns, (F.col("_rank") + F.col("_before") + (start - 1)).cast("long").alias(name))
    )

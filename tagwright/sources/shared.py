"""Tables written once into the folder that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
# A stored table of fewer bytes than this may be dealt over all cores; it is far below what a task
# of its own would read on a cluster's every core.
SMALL_TABLE = 1 << 30
_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may go without it (all tasks then share one machine); on a cluster a
    machine-local folder would be lost with its executor, so that is refused.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tagwright-")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet, so that reruns and concurrent jobs never collide."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    owned = _owned.get()
    if owned is not None:
        owned.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Everything published inside the block is deleted when it ends, also after an error.

    Results read from published tables, so write what is to stay (to a path of your own) inside.
    """
    owned: list[str] = []
    before = _owned.set(owned)
    try:
        yield
    finally:
        _owned.reset(before)
        conf = spark._jsc.hadoopConfiguration()
        for path in owned:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def publish(df: DataFrame, label: str) -> DataFrame:
    """Write a fitted table and return it read back from there.

    This cuts the lineage (a lost executor costs a re-read, not a refit), computes the table once
    however often it is joined, and gives the optimizer its true size.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """The length of all files of a stored table."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def spread(df: DataFrame, path: str, *keys: str, limit: int = SMALL_TABLE) -> DataFrame:
    """``df``, read from ``path``, dealt over all cores by ``keys`` if its files are small.

    A small file of one row group is one task, however much is to be computed from its rows. A table
    of ``limit`` bytes or more has splits enough and is never moved.
    """
    spark = df.sparkSession
    if stored_bytes(spark, path) >= limit:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism, *keys)

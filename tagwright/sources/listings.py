"""Reading and writing listings, word vectors and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwright.functions.words import NA_SPELLINGS
from tagwright.sources.quoted import read_quoted

LISTING = T.StructType(
    [
        T.StructField("listing_id", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("category_name", T.StringType()),
        T.StructField("brand_name", T.StringType()),
        T.StructField("item_description", T.StringType()),
        T.StructField("item_condition_id", T.IntegerType()),
        T.StructField("shipping", T.IntegerType()),
        T.StructField("price", T.DoubleType()),
    ]
)
# Rows of a compressed file: some tens of MB once unpacked.
PACKED_ROWS = 200_000
TEXT_COLUMNS = ["name", "category_name", "brand_name", "item_description"]


def tsv_options(multi_line: bool = True) -> dict[str, str]:
    """Quoted fields may hold tabs, newlines and doubled quotes, and blanks are kept."""
    return {
        "sep": "\t",
        "header": "true",
        "quote": '"',
        "escape": '"',
        "multiLine": str(multi_line).lower(),
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
    }


def na_to_null(df: DataFrame, columns: Sequence[str], spellings: Sequence[str] = NA_SPELLINGS) -> DataFrame:
    """Text that spells a missing value becomes null. Pass fewer spellings if one is a real word."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.when(~F.col(c).isin(*spellings), F.col(c)) for c in present})


def read_listings(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType = LISTING,
    spellings: Sequence[str] = NA_SPELLINGS,
    multi_line: bool = True,
) -> DataFrame:
    """Listings from files with a header. Quoted fields may hold newlines; all tasks read also a single
    file (``quoted``). Where no field holds a newline, ``multi_line=False`` saves the first pass."""
    options = tsv_options(multi_line)
    if multi_line:
        raw = read_quoted(spark, path, schema, options)
    else:
        raw = spark.read.options(**options).schema(schema).csv(path)
    return na_to_null(raw, TEXT_COLUMNS, spellings)


def read_listings_typed(spark: SparkSession, path: str | Sequence[str], types: dict[str, str], **kwargs) -> DataFrame:
    """As ``read_listings``, with some columns given another type."""
    listings = read_listings(spark, path, **kwargs)
    return listings.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def write_listings(df: DataFrame, path: str, packed: bool = False) -> str:
    """Listings as delimited files with a header. ``packed`` compresses them; as such a file is read by one
    task, none then holds more than ``PACKED_ROWS`` rows."""
    options = {"compression": "gzip", "maxRecordsPerFile": str(PACKED_ROWS)} if packed else {}
    df.write.options(**tsv_options(), **options, emptyValue="", nullValue="").csv(path)
    return path


def stream_listings(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """New listings arriving as Parquet files, a bounded number of files per micro-batch."""
    return (
        spark.readStream.schema(LISTING)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word f1 f2 ...`` lines to ``(word, vec array<float>)``."""
    parts = F.split(F.trim("value"), r"\s+", -1)
    return spark.read.text(path).select(
        F.get(parts, F.lit(0)).alias("word"),
        F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("float")).alias("vec"),
    )


def write_word_vectors(df: DataFrame, path: str) -> str:
    line = F.concat_ws(" ", "word", F.transform("vec", lambda x: x.cast("string")))
    df.select(line.alias("value")).write.text(path)
    return path


def write_predictions(df: DataFrame, path: str) -> str:
    """``(listing_id, price)`` with a header. Overwrites, so a repeated job leaves one result."""
    df.select("listing_id", "price").write.mode("overwrite").option("header", True).csv(path)
    return path


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("listing_id string, price double").csv(path)


def is_train() -> Column:
    return F.col("split") == "train"


def is_test() -> Column:
    return F.col("split") == "test"

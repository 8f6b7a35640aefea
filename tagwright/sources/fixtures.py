"""The listings view over the bundled star-schema tables, and the texts used as descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.functions.text import letter_words, tokenize_words
from tagwright.operators.lookup import dense_index
from tagwright.sources.shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ITEM = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_linestatus"
).split()


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing per line item; the SQL twin is ``plans.oracles.LISTINGS``.

    No join is hinted: the optimizer knows each table's file size and broadcasts what is small.
    """
    item = table(spark, sf_dir, "lineitem").select(ITEM)
    item = spread(item, f"{sf_dir}/lineitem.parquet", "l_orderkey", "l_linenumber")
    part = table(spark, sf_dir, "part")
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    turns = table(spark, sf_dir, "conversations")

    part_key, size = F.col("l_partkey"), F.col("p_size")
    joined = (
        item.join(part, part_key == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumns(
            {
                "_conv": part_key % turns.agg(F.max("conv_id") + 1).scalar(),
                "_turn": (F.col("l_linenumber") + F.col("l_suppkey"))
                % turns.agg(F.max("turn") + 1).scalar(),
            }
        )
        .join(
            turns.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "text"),
            ["_conv", "_turn"],
            "left",
        )
    )
    brand = F.replace("p_brand", F.lit("#"), F.when(part_key % 5 == 0, " ").otherwise("-"))
    size_text = size.cast("string")
    path = F.concat_ws("/", "r_name", "n_name", "p_type")
    return joined.select(
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")
        ).alias("listing_id"),
        F.when(F.col("l_orderkey") % 20 == 0, "test").otherwise("train").alias("split"),
        F.when(part_key % 53 == 0, None)
        .when(part_key % 3 == 0, F.concat(brand, F.lit(" "), "p_name", F.lit(" "), size_text, F.lit(" oz ")))
        .otherwise(F.concat("p_name", F.lit(" "), size_text, F.lit(" karat gold")))
        .alias("name"),
        F.when(part_key % 47 == 0, None)
        .when(part_key % 31 == 0, F.concat(path, F.lit("/EXTRA")))
        .otherwise(path)
        .alias("category_name"),
        F.when(size % 3 != 0, brand).alias("brand_name"),
        F.when(part_key % 41 == 0, None)
        .when(part_key % 43 == 0, "No description yet")
        .otherwise(F.col("text"))
        .alias("item_description"),
        (1 + F.col("l_linenumber") % 5).cast("int").alias("item_condition_id"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("shipping"),
        F.when((F.col("l_discount") == 0) & (F.col("l_tax") == 0), 0.0)
        .otherwise(F.col("l_extendedprice"))
        .alias("price"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in the shape of long descriptions: ``(listing_id, item_description)``."""
    docs = stored_documents(spark, sf_dir, "doc_id", "text")
    return docs.select(F.col("doc_id").cast("string").alias("listing_id"), F.col("text").alias("item_description"))


def stored_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Some columns of the documents."""
    return spread(table(spark, sf_dir, "documents").select(*columns), f"{sf_dir}/documents.parquet", "doc_id")


def probe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct letter words of the benchmark texts."""
    texts = table(spark, sf_dir, "benchmark")
    return texts.select(F.explode(letter_words(F.col("text"))).alias("probe")).distinct()


def dictionary_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every letter word of the documents."""
    texts = stored_documents(spark, sf_dir, "doc_id", "text")
    return texts.select(F.explode(letter_words(F.col("text"))).alias("word"))


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark word with a vector: the k-th word in sorted order gets vector k modulo their
    number."""
    texts = table(spark, sf_dir, "benchmark")
    words = texts.select(F.explode(tokenize_words(F.col("text"))).alias("word")).distinct()
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    number = vectors.agg(F.count(F.lit(1))).scalar()
    ranked = dense_index(words, "word", "rank", start=0)
    return ranked.withColumn("vec_id", F.col("rank") % number).join(vectors, "vec_id").select("word", "vec")

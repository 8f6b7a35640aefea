"""Row filters, missing values and derived text columns. All narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.functions import text as tx
from tagwright.functions.words import FALLBACK_PRICE

DENSE_TAGS = {
    "name": "unkname",
    "category_name": "unk_cat",
    "brand_name": "unk_brand",
    "item_description": "nodesc",
}
LEVELS = ["general_cat", "subcat_1", "subcat_2"]


def filter_zero_price(df: DataFrame) -> DataFrame:
    """Training rows need a price above zero; rows to be priced stay."""
    return df.where((F.col("split") == "test") | (F.col("price") > 0))


def split_low_price(df: DataFrame, minimum: float = 1.0) -> DataFrame:
    """Mark each row's role: 'train', 'vocab_only' (too cheap to learn from, its text still counts)
    or 'test'. Only 'train' keeps a price."""
    role = (
        F.when(F.col("split") == "test", "test")
        .when(F.col("price") < minimum, "vocab_only")
        .otherwise("train")
    )
    marked = df.withColumn("role", role)
    return marked.withColumn("price", F.when(F.col("role") == "train", F.col("price")))


def with_categories(df: DataFrame) -> DataFrame:
    parts = tx.split_category(F.col("category_name"))
    return df.withColumns(dict(zip(LEVELS, parts)))


def with_categories4(df: DataFrame) -> DataFrame:
    parts = tx.split_category4(F.col("category_name"))
    return df.withColumns(dict(zip([*LEVELS, "gen_subcat1"], parts)))


def fill_missing_tag(df: DataFrame, tag: str = "missing") -> DataFrame:
    return df.fillna(tag, [*LEVELS, "brand_name", "item_description"])


def fill_missing_dense(df: DataFrame) -> DataFrame:
    return df.fillna(DENSE_TAGS)


def presence_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "has_category": F.col("category_name").isNotNull(),
            "has_brand": F.col("brand_name").isNotNull(),
        }
    )


def fill_empty_lower(df: DataFrame, literal: bool = False) -> DataFrame:
    """Null to empty (category to 'other/other/other'), lower case, placeholder text removed."""
    described = tx.blank_description(tx.lower_or_empty(F.col("item_description")), literal)
    return df.withColumns(
        {
            "category_name": tx.lower_or_empty(F.col("category_name"), "other/other/other"),
            "name": tx.lower_or_empty(F.col("name")),
            "brand_name": tx.lower_or_empty(F.col("brand_name")),
            "item_description": described,
        }
    )


def normalize_units(df: DataFrame) -> DataFrame:
    """Karats first, then units, in name and description."""
    return df.withColumns(
        {c: tx.glue_units(tx.normalize_karats(F.col(c))) for c in ("name", "item_description")}
    )


def cross_keys(df: DataFrame) -> DataFrame:
    names = {"gencat_cond": "general_cat", "subcat_1_cond": "subcat_1", "subcat_2_cond": "subcat_2"}
    condition = F.col("item_condition_id").cast("string")
    return df.withColumns({k: F.concat_ws("_", F.col(c), condition) for k, c in names.items()})


def enrich_name_desc(df: DataFrame) -> DataFrame:
    """The brand is appended to the name; the description gets the longer name, the category levels
    and the brand."""
    named = df.withColumn("name", F.concat_ws(" ", "name", "brand_name"))
    parts = ["item_description", "name", "subcat_1", "subcat_2", "general_cat", "brand_name"]
    return named.withColumn("item_description", F.concat_ws(" ", *parts))


def log_price(price: Column) -> Column:
    return F.log1p(price)


def clip_negative(price: Column) -> Column:
    return F.greatest(price, F.lit(0.0))


def fallback_price(price: Column, fallback: float = FALLBACK_PRICE) -> Column:
    """Rows without a usable estimate get the constant; other rows keep theirs."""
    return F.coalesce(F.nanvl(price, F.lit(None).cast("double")), F.lit(fallback))

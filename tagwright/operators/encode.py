"""Mean encodings, scaling, target standardisation, splits and error measures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.operators.lookup import fits, lookup_join
from tagwright.operators.stats import ENCODED, group_means, min_max, scaled
from tagwright.sources.shared import publish

DENSE = [*ENCODED.values(), "len_desc", "len_name"]


def _is_narrow(df: DataFrame) -> bool:
    return {"len_desc", "len_name"} <= set(df.columns) and not {"item_description", "name"} & set(df.columns)


def text_length(df: DataFrame) -> DataFrame:
    """The lengths of the texts; rows ``narrowed`` hold them in place of the texts."""
    if _is_narrow(df):
        return df
    return df.withColumns({"len_desc": F.length("item_description"), "len_name": F.length("name")})


def join_left_stats(
    df: DataFrame, means: DataFrame, keys: dict[str, str] = ENCODED, small: bool | None = None
) -> DataFrame:
    """Attach the mean of every key; keys not in the fitted table give null. The table is measured
    once for all keys: if it fits as a whole, so does every part of it."""
    small = fits(means) if small is None else small
    for key, name in keys.items():
        one = means.where(F.col("feature") == key).select(
            F.col("key").alias("_key"), F.col("mean").alias(name), F.col("n").alias("_n")
        )
        keyed = df.withColumn("_key", F.col(key).cast("string"))
        df = lookup_join(keyed, one, "_key", weight="_n", small=small or None).drop("_key", "_n")
    return df


def fill_unseen(df: DataFrame, names: Sequence[str], value: Column | float = 0.0) -> DataFrame:
    fill = F.lit(value) if isinstance(value, (int, float)) else value
    return df.withColumns({c: F.coalesce(F.col(c), fill) for c in names})


def one_row(table: DataFrame) -> Column:
    """A one-row table as a struct; used in many places, it is still computed once."""
    return table.select(F.struct(*table.columns)).scalar()


def minmax_scale(df: DataFrame, ranges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``ranges`` is the single row of ``min_max``: one scalar subquery, never collected."""
    row = one_row(ranges)
    return df.withColumns({c: scaled(F.col(c), row[f"{c}_min"], row[f"{c}_max"]) for c in columns})


@dataclass
class DenseEncoding:
    """Fitted tables of the dense features: means per key and the ranges of all six columns."""

    means: DataFrame
    ranges: DataFrame
    unseen: str = "zero"
    small: bool | None = None

    def save(self, path: str) -> None:
        """Store the fitted tables below ``path``; ``load`` gives the same encoding in any session."""
        self.means.write.parquet(f"{path}/means")
        self.ranges.withColumn("unseen", F.lit(self.unseen)).write.parquet(f"{path}/ranges")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DenseEncoding:
        means, ranges = (spark.read.parquet(f"{path}/{part}") for part in ("means", "ranges"))
        return cls(means, ranges.drop("unseen"), ranges.first()["unseen"], fits(means))

    def apply(self, df: DataFrame) -> DataFrame:
        out = self.unscaled(df)
        return minmax_scale(out, self.ranges, DENSE)

    def unscaled(self, df: DataFrame) -> DataFrame:
        joined = join_left_stats(df, self.means, small=self.small)
        fill = 0.0 if self.unseen == "zero" else self.ranges.select("overall").scalar()
        return text_length(fill_unseen(joined, list(ENCODED.values()), fill))


def narrowed(rows: DataFrame, *columns: str) -> DataFrame:
    """What ``fit_dense`` and ``apply`` read of filled rows, and ``columns``, written once: the lengths of
    the texts in place of the texts. Both then read it and neither makes the rows again."""
    return publish(text_length(rows).select(*columns, *ENCODED, "len_desc", "len_name"), "narrow")


def fit_dense(train: DataFrame, target: str = "log_price", unseen: str = "zero") -> DenseEncoding:
    """Fit on training rows whose missing texts are already filled.

    The columns needed are written once; the means and the ranges are read off that narrow table, and
    the overall mean off the table of means (every row counts once under each key). Rows ``narrowed`` are
    written already.
    """
    narrow = text_length(train).select(*ENCODED, "len_desc", "len_name", target)
    if not _is_narrow(train):
        narrow = publish(narrow, "narrow")
    means = publish(group_means(narrow, target), "means")
    small = fits(means)
    ranges = min_max(join_left_stats(narrow, means, small=small), DENSE)
    one = means.where(F.col("feature") == next(iter(ENCODED)))
    overall = one.agg(F.sum(F.col("mean") * F.col("n")) / F.sum("n")).scalar()
    return DenseEncoding(means, publish(ranges.withColumn("overall", overall), "ranges"), unseen, small)


def standardize(df: DataFrame, moments: DataFrame, column: str, name: str) -> DataFrame:
    row = one_row(moments)
    return df.withColumn(name, (F.col(column) - row["mean"]) / row["std"])


def unstandardize(df: DataFrame, moments: DataFrame, column: str, name: str) -> DataFrame:
    row = one_row(moments)
    return df.withColumn(name, F.col(column) * row["std"] + row["mean"])


def hash_percent(key: Column, seed: int = 100) -> Column:
    """0..99 from md5 of seed and key: the same row falls on the same side however it is stored."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("long") % 100


def train_valid_split(df: DataFrame, percent: int = 5, seed: int = 100) -> DataFrame:
    held = hash_percent(F.col("listing_id"), seed) < percent
    return df.withColumn("fold", F.when(held, "valid").otherwise("train"))


def fold_of(key: Column, folds: int, seed: int = 7) -> Column:
    """0..folds-1 by md5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("long") % folds


def out_of_fold(
    train: DataFrame, target: str, folds: int = 5, leaky: bool = False, keys: dict[str, str] = ENCODED
) -> DataFrame:
    """Training rows with their mean encodings, none of which has seen the row's own target.

    One aggregation by key and fold gives both: the mean of all folds but the row's own is the total
    less its fold's part. A value that occurs in one fold only has no such mean and gets 0, as a value
    never seen does. ``leaky=True`` uses all rows, the row's own included.
    """
    placed = train.withColumn("_fold", F.lit(0) if leaky else fold_of(F.col("listing_id"), folds))
    named = placed.select(*[F.col(k).cast("string").alias(k) for k in keys], "_fold", F.col(target).alias("_y"))
    grouped = named.groupingSets([["_fold", k] for k in keys], "_fold", *keys).agg(
        F.sum("_y").alias("s"), F.count(F.lit(1)).alias("n"), *[F.grouping(k).alias(f"_g_{k}") for k in keys]
    )
    feature = F.coalesce(*[F.when(F.col(f"_g_{k}") == 0, F.lit(k)) for k in keys])
    key = F.coalesce(*[F.when(F.col(f"_g_{k}") == 0, F.col(k)) for k in keys])
    parts = grouped.select("_fold", feature.alias("feature"), key.alias("_key"), "s", "n")
    whole = parts.groupBy("feature", "_key").agg(F.sum("s").alias("s_all"), F.sum("n").alias("n_all"))
    other = F.col("n_all") - (F.lit(0) if leaky else F.col("n"))
    total = F.col("s_all") - (F.lit(0.0) if leaky else F.col("s"))
    table = parts.join(whole, ["feature", "_key"]).where(other > 0)
    table = publish(table.select("feature", "_key", "_fold", (total / other).alias("mean"), "n"), "fold-means")
    small = fits(table)
    for column, name in keys.items():
        one = table.where(F.col("feature") == column).select("_key", "_fold", F.col("mean").alias(name), F.col("n").alias("_n"))
        keyed = placed.withColumn("_key", F.col(column).cast("string"))
        placed = lookup_join(keyed, one, ["_key", "_fold"], weight="_n", small=small or None).drop("_key", "_n")
    return fill_unseen(placed.drop("_fold"), list(keys.values()))


def condition_onehot5(condition: Column, depth: int = 5) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: (i == condition - 1).cast("int")
    )


def rmsle(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    error = F.pow(F.log1p(F.col(actual)) - F.log1p(F.col(predicted)), F.lit(2.0))
    return df.groupBy(*by).agg(F.sqrt(F.avg(error)).alias("rmsle"), F.count(F.lit(1)).alias("n"))


def blend(weights: dict[str, float], scale: str = "price") -> Column:
    """Weighted mean of predictions of ``log1p(price)``: of the prices, or of the logs."""
    if scale == "log":
        return F.expm1(sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)))
    return sum((F.expm1(F.col(c)) * w for c, w in weights.items()), F.lit(0.0))


def join_predictions(*parts: DataFrame, how: str = "inner") -> DataFrame:
    """Predictions of several models side by side, matched by listing, never by position; ``left``
    keeps all listings of the first part."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "listing_id", how)
    return out

"""Registered queries: joins with fitted tables, aggregates, top lists, encodings and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.operators import encode, stats
from tagwright.operators import vocab as vo
from tagwright.functions import text as tx
from tagwright.plans import inputs
from tagwright.plans.oracles import over, scaled, tokenized
from tagwright.plans.registry import query
from tagwright.sources import fixtures
from tagwright.sources.listings import is_train
from tagwright.sources.shared import publish

ENCODED = stats.ENCODED
MEANS = list(ENCODED.values())
ROUNDED_MEANS = ", ".join(f"round({c}, 6) AS {c}" for c in MEANS)


def rounded(*columns: str, digits: int = 6) -> list:
    return [F.round(c, digits).alias(c) for c in columns]


# ---- joins ------------------------------------------------------------------------------------

@query(over("encoded", f"SELECT listing_id, {ROUNDED_MEANS} FROM encoded WHERE split = 'train'"))
def join_left_stats(spark: SparkSession, d: str) -> DataFrame:
    train = inputs.train(spark, d)
    means = publish(stats.group_means(train, "log_price"), "means")
    return encode.join_left_stats(train, means).select("listing_id", *rounded(*MEANS))


@query(over("dense", f"SELECT listing_id, {ROUNDED_MEANS} FROM dense WHERE split = 'test'"))
def join_left_stats_test(spark: SparkSession, d: str) -> DataFrame:
    means = publish(stats.group_means(inputs.train(spark, d), "log_price"), "means")
    joined = encode.join_left_stats(inputs.test(spark, d), means)
    return encode.fill_unseen(joined, MEANS).select("listing_id", *rounded(*MEANS))


SLUGS = "SELECT listing_id, replace(lower(brand_name), ' ', '_') AS brand, split FROM filled"
BRAND_INDEX = """SELECT brand, count(*) AS n, row_number() OVER (ORDER BY brand) AS idx FROM slugs
    WHERE split = 'train' AND brand <> 'unk_brand' GROUP BY brand HAVING count(*) >= 50"""


def _slugs(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.filled(spark, d)
    return rows.select("listing_id", tx.brand_slug(F.col("brand_name")).alias("brand"), "split")


@query(over("filled", "SELECT brand, n, idx FROM brand_index", slugs=SLUGS, brand_index=BRAND_INDEX))
def min_count_index(spark: SparkSession, d: str) -> DataFrame:
    train = _slugs(spark, d).where(is_train())
    return stats.min_count_index(train, "brand", 50, skip="unk_brand").select("brand", "n", "idx")


@query(
    over(
        "filled",
        "SELECT s.listing_id, s.brand, coalesce(i.idx, 0) AS idx FROM slugs s LEFT JOIN brand_index i USING (brand)",
        slugs=SLUGS,
        brand_index=BRAND_INDEX,
    )
)
def lookup_index(spark: SparkSession, d: str) -> DataFrame:
    rows = _slugs(spark, d)
    index = publish(stats.min_count_index(rows.where(is_train()), "brand", 50, skip="unk_brand"), "brands")
    return stats.lookup_index(rows, index, "brand").select("listing_id", "brand", "idx")


TOPS = {"brand_name": 10, "general_cat": 3, "subcat_1": 12, "subcat_2": 4}


def _top_sql(column: str, n: int) -> str:
    return (
        f"SELECT {column} FROM tagged WHERE split = 'train' AND {column} <> 'missing' "
        f"GROUP BY 1 ORDER BY count(*) DESC, {column} LIMIT {n}"
    )


@query(
    over(
        "tagged",
        f"""SELECT listing_id, CASE WHEN brand_name IN ({_top_sql('brand_name', 10)}) THEN brand_name ELSE 'missing' END AS brand_name
        FROM tagged""",
    )
)
def semi_membership(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.tagged(spark, d)
    kept = publish(stats.top_values(rows.where(is_train()), "brand_name", 10), "top-brands")
    return stats.keep_values(rows, kept, "brand_name").select("listing_id", "brand_name")


@query(
    over(
        "tagged",
        "SELECT listing_id, "
        + ", ".join(
            f"CASE WHEN {c} IN (SELECT {c} FROM top_{c}) THEN {c} ELSE 'missing' END AS {c}" for c in TOPS
        )
        + " FROM tagged",
        **{f"top_{c}": _top_sql(c, n) for c, n in TOPS.items()},
    )
)
def topk_keep(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.tagged(spark, d)
    return stats.topk_keep(rows, TOPS, rows.where(is_train())).select("listing_id", *TOPS)


# ---- aggregates -------------------------------------------------------------------------------

@query(over("means", "SELECT feature, key, round(mean, 6) AS mean, n FROM means"))
def group_mean(spark: SparkSession, d: str) -> DataFrame:
    means = stats.group_means(inputs.train(spark, d), "log_price")
    return means.select("feature", "key", *rounded("mean"), "n")


@query(over("means", "SELECT feature, key, round(mean, 6) AS mean, n FROM means"))
def merged_means(spark: SparkSession, d: str) -> DataFrame:
    """The means again, from the states of four chunks that are merged pair by pair, in another order."""
    rows = inputs.train(spark, d)
    chunk = encode.hash_percent(F.col("listing_id")) % 4
    parts = [publish(stats.partial_state(rows.where(chunk == i), "log_price"), "state") for i in (2, 0, 3, 1)]
    state = stats.merge_states(stats.merge_states(*parts[:2]), stats.merge_states(*parts[2:]))
    return stats.state_means(state).select("feature", "key", *rounded("mean"), "n")


FOLD = "CAST(concat('0x', substr(md5(concat('7:', listing_id)), 1, 8)) AS BIGINT) % 5"
FOLD_MEANS = " UNION ALL ".join(
    f"""SELECT '{k}' AS feature, key, fold, (sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0) AS mean FROM (
          SELECT CAST({k} AS VARCHAR) AS key, fold, sum(log_price) AS s, count(*) AS n FROM folded GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY key)"""
    for k in ENCODED
)


@query(
    over(
        "train",
        "SELECT f.listing_id, "
        + ", ".join(f"round(coalesce({n}_t.mean, 0), 6) AS {n}" for n in ENCODED.values())
        + " FROM folded f "
        + " ".join(
            f"LEFT JOIN fold_means {n}_t ON {n}_t.feature = '{k}' AND {n}_t.key = CAST(f.{k} AS VARCHAR) AND {n}_t.fold = f.fold"
            for k, n in ENCODED.items()
        ),
        folded=f"SELECT *, {FOLD} AS fold FROM train",
        fold_means=FOLD_MEANS,
    )
)
def target_encode_folds(spark: SparkSession, d: str) -> DataFrame:
    """Training rows with means that have not seen their own fold."""
    found = encode.out_of_fold(inputs.train(spark, d), "log_price")
    return found.select("listing_id", *rounded(*ENCODED.values()))


@query(
    over(
        "train",
        """SELECT category_name, round(ln(avg(price)), 6) AS log_of_raw_mean,
             round((sum(log_price) + (SELECT avg(log_price) FROM train) * 10) / (count(*) + 10), 6) AS cat_mean, count(*) AS n
           FROM train GROUP BY 1""",
    )
)
def smoothed_mean(spark: SparkSession, d: str) -> DataFrame:
    train = inputs.train(spark, d)
    smooth = stats.smoothed_mean(train, "category_name", "log_price", "cat_mean", alpha=10.0)
    raw = stats.group_mean(train, "category_name", "price", "raw_mean").drop("n").withColumn("log_of_raw_mean", F.log("raw_mean"))
    both = smooth.join(raw, "category_name")
    return both.select("category_name", *rounded("log_of_raw_mean", "cat_mean"), "n")


@query(over("tagged", "SELECT brand_name, count(*) AS n FROM tagged GROUP BY 1"))
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.value_counts(inputs.tagged(spark, d), "brand_name")


@query(
    over(
        "docs",
        f"""SELECT token, count(*) AS df FROM (
              SELECT listing_id, unnest(list_distinct({tokenized('item_description')})) AS token FROM docs)
            GROUP BY 1""",
    )
)
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    docs = fixtures.documents(spark, d)
    return vo.doc_freq(docs.withColumn("tokens", tx.tokenize_words(F.col("item_description"))))


@query(over("train", "SELECT round(avg(log_price), 6) AS mean, round(stddev_pop(log_price), 6) AS std FROM train"))
def global_moments(spark: SparkSession, d: str) -> DataFrame:
    return stats.global_moments(inputs.train(spark, d), "log_price").select(*rounded("mean", "std"))


@query(
    over(
        "dense",
        "SELECT "
        + ", ".join(f"round({f}({c}), 6) AS {c}_{f}" for c in encode.DENSE for f in ("min", "max"))
        + " FROM dense WHERE split = 'train'",
    )
)
def min_max(spark: SparkSession, d: str) -> DataFrame:
    train = inputs.train(spark, d)
    means = publish(stats.group_means(train, "log_price"), "means")
    rows = encode.text_length(encode.join_left_stats(train, means))
    ranges = stats.min_max(rows, encode.DENSE)
    return ranges.select(*[F.round(F.col(c).cast("double"), 6).alias(c) for c in ranges.columns])


@query(
    over(
        "filled",
        f"""SELECT token, count(*) AS df, row_number() OVER (ORDER BY token) AS place FROM (
              SELECT listing_id, unnest(list_distinct({tokenized('name')})) AS token FROM filled)
            GROUP BY 1""",
    )
)
def vocab_sort(spark: SparkSession, d: str) -> DataFrame:
    names = inputs.filled(spark, d).select("listing_id", tx.tokenize_words(F.col("name")).alias("tokens"))
    return vo.vocab_sort(vo.doc_freq(names))


@query(
    over(
        "listings",
        """SELECT listing_id, role, price FROM (
             SELECT listing_id, 'train' AS role, price FROM listings WHERE split = 'train' AND price >= 1.0
             UNION ALL SELECT listing_id, 'vocab_only', NULL FROM listings WHERE split = 'train' AND price < 1.0
             UNION ALL SELECT listing_id, 'test', NULL FROM listings WHERE split = 'test')""",
    )
)
def union_splits(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.listings(spark, d).select("listing_id", "split", "price")
    train = rows.where(is_train())
    parts = [
        train.where("price >= 1.0").withColumn("role", F.lit("train")),
        train.where("price < 1.0").drop("price").withColumn("role", F.lit("vocab_only")),
        rows.where("split = 'test'").drop("price").withColumn("role", F.lit("test")),
    ]
    return stats.union_splits(*parts).select("listing_id", "role", "price")


# ---- scaling and encodings --------------------------------------------------------------------

RANGES = "SELECT {} FROM dense WHERE split = 'train'".format(
    ", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max" for c in encode.DENSE)
)
SCALED = ", ".join(f"round({scaled(c, c + '_min', c + '_max')}, 6) AS {c}" for c in encode.DENSE)
SCALED_SQL = over("dense", f"SELECT listing_id, split, {SCALED} FROM dense, ranges", ranges=RANGES)


@query(
    over(
        "dense",
        "SELECT listing_id, "
        + ", ".join(f"round({scaled(c, c + '_min', c + '_max')}, 6) AS {c}" for c in ("len_desc", "len_name"))
        + " FROM dense, ranges",
        ranges=RANGES,
    )
)
def minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    columns = ["len_desc", "len_name"]
    rows = encode.text_length(inputs.filled(spark, d)).select("listing_id", "split", *columns)
    ranges = stats.min_max(rows.where(is_train()), columns)
    return encode.minmax_scale(rows, ranges, columns).select("listing_id", *rounded(*columns))


@query(SCALED_SQL)
def target_encode(spark: SparkSession, d: str) -> DataFrame:
    rows = encode.narrowed(inputs.filled(spark, d), "listing_id", "split", "log_price")
    return encode.fit_dense(rows.where(is_train())).apply(rows).select("listing_id", "split", *rounded(*encode.DENSE))


@query(
    over(
        "filled",
        """SELECT listing_id, round((log_price - mean) / std, 6) AS z, round((log_price - mean) / std * std + mean, 6) AS back
           FROM filled, (SELECT avg(log_price) AS mean, stddev_pop(log_price) AS std FROM train)""",
        train="SELECT * FROM filled WHERE split = 'train'",
    )
)
def standardize_target(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.filled(spark, d).select("listing_id", "split", "log_price")
    moments = publish(stats.global_moments(rows.where(is_train()), "log_price"), "moments")
    z = encode.standardize(rows, moments, "log_price", "z")
    return encode.unstandardize(z, moments, "z", "back").select("listing_id", *rounded("z", "back"))


@query(
    over(
        "train",
        """SELECT listing_id, CASE WHEN CAST(concat('0x', substr(md5('100:' || listing_id), 1, 8)) AS BIGINT) % 100 < 5
             THEN 'valid' ELSE 'train' END AS fold FROM train""",
    )
)
def train_valid_split(spark: SparkSession, d: str) -> DataFrame:
    return encode.train_valid_split(inputs.train(spark, d), 5).select("listing_id", "fold")


@query(
    over(
        "filled",
        "SELECT listing_id, array_to_string(list_transform(range(0, 5), "
        "lambda i: CASE WHEN i = item_condition_id - 1 THEN 1 ELSE 0 END), ' ') AS onehot FROM filled",
    )
)
def condition_onehot5(spark: SparkSession, d: str) -> DataFrame:
    onehot = F.transform(encode.condition_onehot5(F.col("item_condition_id")), lambda x: x.cast("string"))
    return inputs.filled(spark, d).select("listing_id", F.array_join(onehot, " ").alias("onehot"))


# ---- estimates and their error ----------------------------------------------------------------

def _estimates(spark: SparkSession, d: str) -> DataFrame:
    """The encoded means of every listing, on the log scale."""
    means = publish(stats.group_means(inputs.train(spark, d), "log_price"), "means")
    joined = encode.join_left_stats(inputs.filled(spark, d), means)
    return encode.fill_unseen(joined, MEANS)


@query(
    over(
        "dense",
        """SELECT split, CAST(item_condition_id AS BIGINT) AS item_condition_id,
             round(sqrt(avg(power(ln(1 + price) - ln(1 + (exp(cat_mean) - 1)), 2))), 6) AS rmsle, count(*) AS n
           FROM dense WHERE price > 0 GROUP BY 1, 2""",
    )
)
def rmsle(spark: SparkSession, d: str) -> DataFrame:
    rows = _estimates(spark, d).where("price > 0").withColumn("estimate", F.expm1("cat_mean"))
    errors = encode.rmsle(rows, "price", "estimate", ["split", "item_condition_id"])
    return errors.select("split", F.col("item_condition_id").cast("long"), *rounded("rmsle"), "n")


@query(
    over(
        "dense",
        """SELECT listing_id,
             round(0.10::DOUBLE * (exp(cat_mean) - 1) + 0.60::DOUBLE * (exp(brand_mean) - 1) + 0.30::DOUBLE * (exp(cond_mean) - 1), 4) AS price,
             round(exp(0.10::DOUBLE * cat_mean + 0.30::DOUBLE * brand_mean + 0.60::DOUBLE * cond_mean) - 1, 4) AS log_blend
           FROM dense WHERE split = 'test'""",
    )
)
def blend(spark: SparkSession, d: str) -> DataFrame:
    rows = _estimates(spark, d).where("split = 'test'")
    parts = [rows.select("listing_id", c) for c in ("cat_mean", "brand_mean", "cond_mean")]
    joined = encode.join_predictions(*parts)
    price = encode.blend({"cat_mean": 0.10, "brand_mean": 0.60, "cond_mean": 0.30})
    logs = encode.blend({"cat_mean": 0.10, "brand_mean": 0.30, "cond_mean": 0.60}, scale="log")
    return joined.select(
        "listing_id", F.round(price, 4).alias("price"), F.round(logs, 4).alias("log_blend")
    )


@query(
    over(
        "dense",
        """SELECT split, round(sqrt(avg(power(log_price - (cat_mean + cond_mean + brand_mean + ship_mean) / 4, 2))), 6) AS means_rmsle,
             round(sqrt(avg(power(log_price - (SELECT avg(log_price) FROM dense WHERE split = 'train'), 2))), 6) AS constant_rmsle,
             round(avg(exp((cat_mean + cond_mean + brand_mean + ship_mean) / 4) - 1), 2) AS mean_estimate, count(*) AS n
           FROM dense WHERE price > 0 GROUP BY 1""",
    )
)
def price_report(spark: SparkSession, d: str) -> DataFrame:
    """How well the mean of the four encodings prices a listing, against a constant guess; listings
    without a price cannot be judged."""
    rows = _estimates(spark, d).where("price > 0")
    guess = inputs.train(spark, d).agg(F.avg("log_price")).scalar()
    average = sum((F.col(c) for c in MEANS), F.lit(0.0)) / len(MEANS)
    priced = rows.withColumns({"estimate": F.expm1(average), "constant": F.expm1(guess)})

    def error(column: str):
        gap = F.log1p("price") - F.log1p(column)
        return F.sqrt(F.avg(gap * gap))

    return priced.groupBy("split").agg(
        F.round(error("estimate"), 6).alias("means_rmsle"),
        F.round(error("constant"), 6).alias("constant_rmsle"),
        F.round(F.avg("estimate"), 2).alias("mean_estimate"),
        F.count(F.lit(1)).alias("n"),
    )

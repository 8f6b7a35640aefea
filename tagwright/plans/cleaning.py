"""Registered queries: reading, writing, cleaning, string and category functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.functions import text as tx
from tagwright.operators import clean, stats
from tagwright.operators import encode
from tagwright.operators.lookup import lookup_join
from tagwright.plans import inputs
from tagwright.plans.oracles import KARATS, normalized, over, plain, scaled, tokenized, units
from tagwright.plans.registry import query
from tagwright.sources import fixtures
from tagwright.sources import listings as src
from tagwright.sources.shared import fresh_path, publish
from tagwright.streaming.scoring import scan_chunked as copy_chunks

TEXTS = ["name", "category_name", "brand_name", "item_description"]
ALL = "listing_id, split, name, category_name, brand_name, item_description, item_condition_id, shipping, price"


def written_tsv(spark: SparkSession, d: str, packed: bool = True) -> str:
    return src.write_listings(fixtures.listings(spark, d), fresh_path(spark, "tsv"), packed)


@query(over("listings", f"SELECT {ALL} FROM listings"))
def scan_listings_tsv(spark: SparkSession, d: str) -> DataFrame:
    return src.read_listings(spark, written_tsv(spark, d))


@query(over("listings", "SELECT listing_id FROM listings"))
def scan_projected(spark: SparkSession, d: str) -> DataFrame:
    return src.read_listings(spark, written_tsv(spark, d)).select("listing_id")


@query(
    over(
        "listings",
        "SELECT listing_id, CAST(item_condition_id AS VARCHAR) AS item_condition_id, "
        "CAST(shipping AS VARCHAR) AS shipping, price FROM listings",
    )
)
def scan_typed(spark: SparkSession, d: str) -> DataFrame:
    types = {"item_condition_id": "string", "shipping": "string"}
    rows = src.read_listings_typed(spark, written_tsv(spark, d), types)
    return rows.select("listing_id", "item_condition_id", "shipping", "price")


@query(over("listings", f"SELECT {ALL} FROM listings"))
def scan_chunked(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.schema(src.LISTING).parquet(f"{copy_chunks(spark, written_tsv(spark, d, packed=False), 2)}/chunk=*")


WORD_VECTORS = """SELECT r.word, e.embedding AS vec FROM (
    SELECT word, row_number() OVER (ORDER BY word) - 1 AS vec_id
    FROM (SELECT DISTINCT unnest({tokens}) AS word FROM benchmark)) r
  JOIN embeddings e ON e.vec_id = r.vec_id % (SELECT count(*) FROM embeddings)""".format(tokens=tokenized("text"))


@query(
    plain(
        "SELECT word, CAST(unnest(range(0, len(vec))) AS BIGINT) AS dim, "
        "CAST(unnest(vec) AS DOUBLE) AS value FROM vectors",
        vectors=WORD_VECTORS,
    )
)
def scan_word_vectors(spark: SparkSession, d: str) -> DataFrame:
    path = src.write_word_vectors(fixtures.word_vectors(spark, d), fresh_path(spark, "vectors"))
    read = src.read_word_vectors(spark, path)
    return read.select("word", F.posexplode("vec").alias("dim", "value")).select(
        "word", F.col("dim").cast("long").alias("dim"), F.col("value").cast("double").alias("value")
    )


@query(
    over(
        ["test", "means"],
        """SELECT t.listing_id, round(exp(coalesce(m.mean, 0)) - 1, 4) AS price FROM test t
           LEFT JOIN means m ON m.feature = 'category_name' AND m.key = t.category_name""",
    )
)
def sink_predictions_csv(spark: SparkSession, d: str) -> DataFrame:
    means = publish(stats.group_mean(inputs.train(spark, d), "category_name", "log_price", "mean"), "means")
    test = lookup_join(inputs.test(spark, d), means, "category_name", weight="n")
    price = F.round(F.expm1(F.coalesce("mean", F.lit(0.0))), 4)
    path = src.write_predictions(test.select("listing_id", price.alias("price")), fresh_path(spark, "out"))
    return src.read_predictions(spark, path)


# ---- filters and missing values ---------------------------------------------------------------

@query(over("priced", "SELECT listing_id, split, price FROM priced"))
def filter_zero_price(spark: SparkSession, d: str) -> DataFrame:
    return inputs.priced(spark, d).select("listing_id", "split", "price")


@query(
    over(
        "listings",
        """SELECT listing_id, CASE WHEN split = 'test' THEN 'test' WHEN price < 1.0 THEN 'vocab_only' ELSE 'train' END AS role,
           CASE WHEN split = 'train' AND price >= 1.0 THEN round(ln(1 + price), 6) END AS log_price FROM listings""",
    )
)
def split_low_price(spark: SparkSession, d: str) -> DataFrame:
    rows = clean.split_low_price(fixtures.listings(spark, d))
    return rows.select("listing_id", "role", F.round(clean.log_price(F.col("price")), 6).alias("log_price"))


@query(
    over(
        "tagged",
        "SELECT listing_id, general_cat, subcat_1, subcat_2, brand_name, item_description FROM tagged",
    )
)
def fill_missing_tag(spark: SparkSession, d: str) -> DataFrame:
    return inputs.tagged(spark, d).select(
        "listing_id", "general_cat", "subcat_1", "subcat_2", "brand_name", "item_description"
    )


@query(over("filled", f"SELECT listing_id, {', '.join(TEXTS)} FROM filled"))
def fill_missing_dense(spark: SparkSession, d: str) -> DataFrame:
    return inputs.filled(spark, d).select("listing_id", *TEXTS)


@query(over("lowered", f"SELECT listing_id, {', '.join(TEXTS)} FROM lowered"))
def fill_empty_lower(spark: SparkSession, d: str) -> DataFrame:
    return inputs.lowered(spark, d).select("listing_id", *TEXTS)


@query(
    over(
        "listings",
        "SELECT listing_id, category_name IS NOT NULL AS has_category, brand_name IS NOT NULL AS has_brand FROM listings",
    )
)
def presence_flags(spark: SparkSession, d: str) -> DataFrame:
    flagged = clean.presence_flags(fixtures.listings(spark, d))
    return flagged.select("listing_id", "has_category", "has_brand")


@query(
    over(
        "cats4",
        """SELECT listing_id, concat(general_cat, '_', item_condition_id) AS gencat_cond,
           concat(subcat_1, '_', item_condition_id) AS subcat_1_cond,
           concat(subcat_2, '_', item_condition_id) AS subcat_2_cond FROM cats4""",
    )
)
def cross_keys(spark: SparkSession, d: str) -> DataFrame:
    crossed = clean.cross_keys(inputs.cats4(spark, d))
    return crossed.select("listing_id", "gencat_cond", "subcat_1_cond", "subcat_2_cond")


@query(
    over(
        "cats4",
        """SELECT listing_id, name || ' ' || brand_name AS name,
           concat_ws(' ', item_description, name || ' ' || brand_name, subcat_1, subcat_2, general_cat, brand_name)
             AS item_description FROM cats4""",
    )
)
def enrich_name_desc(spark: SparkSession, d: str) -> DataFrame:
    return clean.enrich_name_desc(inputs.cats4(spark, d)).select("listing_id", "name", "item_description")


@query(
    over(
        "priced",
        "SELECT listing_id, round(ln(1 + price), 6) AS log_price, round(exp(ln(1 + price)) - 1, 4) AS back FROM priced",
    )
)
def log_price(spark: SparkSession, d: str) -> DataFrame:
    logged = clean.log_price(F.col("price"))
    return inputs.priced(spark, d).select(
        "listing_id", F.round(logged, 6).alias("log_price"), F.round(F.expm1(logged), 4).alias("back")
    )


@query(
    over(
        "tagged",
        "SELECT name, general_cat, subcat_1, subcat_2, brand_name, item_description, item_condition_id, shipping FROM tagged",
    )
)
def drop_columns(spark: SparkSession, d: str) -> DataFrame:
    return inputs.tagged(spark, d).drop("listing_id", "split", "price", "category_name")


@query(
    over(
        "priced",
        "SELECT listing_id, round(greatest(price - (SELECT avg(price) FROM priced), 0.0), 2) AS above FROM priced",
    )
)
def clip_negative(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.priced(spark, d)
    estimate = F.col("price") - rows.agg(F.avg("price")).scalar()
    return rows.select("listing_id", F.round(clean.clip_negative(estimate), 2).alias("above"))


PAIR_MEANS = """SELECT category_name, brand_name, item_condition_id, avg(log_price) AS mean
    FROM train WHERE shipping = 1 GROUP BY ALL"""


@query(
    over(
        ["train", "test"],
        """SELECT t.listing_id, round(coalesce(exp(m.mean) - 1, 26.7), 4) AS price FROM test t LEFT JOIN pair_means m
           USING (category_name, brand_name, item_condition_id)""",
        pair_means=PAIR_MEANS,
    )
)
def fallback_price(spark: SparkSession, d: str) -> DataFrame:
    keys = ["category_name", "brand_name", "item_condition_id"]
    shipped = inputs.train(spark, d).where("shipping = 1")
    means = shipped.groupBy(*keys).agg(F.avg("log_price").alias("mean"), F.count(F.lit(1)).alias("n"))
    test = lookup_join(inputs.test(spark, d), publish(means, "means"), keys, weight="n")
    return test.select("listing_id", F.round(clean.fallback_price(F.expm1("mean")), 4).alias("price"))


# ---- strings and categories -------------------------------------------------------------------

@query(over("cats", "SELECT listing_id, general_cat, subcat_1, subcat_2 FROM cats"))
def split_category(spark: SparkSession, d: str) -> DataFrame:
    rows = clean.with_categories(fixtures.listings(spark, d))
    return rows.select("listing_id", *clean.LEVELS)


@query(over("cats4", "SELECT listing_id, general_cat, subcat_1, subcat_2, gen_subcat1 FROM cats4"))
def split_category4(spark: SparkSession, d: str) -> DataFrame:
    return inputs.cats4(spark, d).select("listing_id", *clean.LEVELS, "gen_subcat1")


@query(
    over(
        "filled",
        """SELECT listing_id, array_to_string(list_transform(range(1, len(p) + 1),
             lambda i: array_to_string(p[1:i], '/')), ' ') AS paths
           FROM (SELECT listing_id, string_split(regexp_replace(lower(category_name), '[\\s\\p{Z}]+', '', 'g'), '/') AS p FROM filled)""",
    )
)
def category_paths(spark: SparkSession, d: str) -> DataFrame:
    paths = tx.category_paths(F.col("category_name"))
    return inputs.filled(spark, d).select("listing_id", F.array_join(paths, " ").alias("paths"))


@query(
    over(
        ["filled", "docs"],
        f"""SELECT listing_id, array_to_string({normalized('name')}, ' ') AS words FROM filled
        UNION ALL SELECT 'doc-' || listing_id, array_to_string({normalized('item_description')}, ' ') FROM docs""",
    )
)
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    names = inputs.filled(spark, d).select("listing_id", tx.normalize_text(F.col("name")).alias("words"))
    docs = fixtures.documents(spark, d).select(
        F.concat(F.lit("doc-"), "listing_id").alias("listing_id"),
        tx.normalize_text(F.col("item_description")).alias("words"),
    )
    return names.unionByName(docs)


@query(
    over(
        "docs",
        f"SELECT listing_id, array_to_string({tokenized('item_description')}, ' ') AS tokens FROM docs",
    )
)
def tokenize_words(spark: SparkSession, d: str) -> DataFrame:
    tokens = tx.tokenize_words(F.col("item_description"))
    return fixtures.documents(spark, d).select("listing_id", F.array_join(tokens, " ").alias("tokens"))


@query(over("filled", "SELECT listing_id, replace(lower(brand_name), ' ', '_') AS brand FROM filled"))
def brand_slug(spark: SparkSession, d: str) -> DataFrame:
    return inputs.filled(spark, d).select("listing_id", tx.brand_slug(F.col("brand_name")).alias("brand"))


@query(over("unified", "SELECT listing_id, name FROM lowered_karats", lowered_karats="""
    SELECT listing_id, regexp_replace(name, '{k}', '\\1k\\4', 'g') AS name FROM lowered""".format(k=KARATS)))
def normalize_karats(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.lowered(spark, d)
    return rows.select("listing_id", tx.normalize_karats(F.col("name")).alias("name"))


@query(
    over(
        ["unified", "docs"],
        f"""SELECT listing_id, name AS value FROM unified
            UNION ALL SELECT 'doc-' || listing_id, {units('lower(item_description)')} FROM docs""",
    )
)
def glue_units(spark: SparkSession, d: str) -> DataFrame:
    names = inputs.unified(spark, d).select("listing_id", F.col("name").alias("value"))
    docs = fixtures.documents(spark, d).select(
        F.concat(F.lit("doc-"), "listing_id").alias("listing_id"),
        tx.glue_units(tx.normalize_karats(F.lower("item_description"))).alias("value"),
    )
    return names.unionByName(docs)


@query(
    over(
        "filled",
        "SELECT listing_id, length(item_description) AS len_desc, length(name) AS len_name FROM filled",
    )
)
def text_length(spark: SparkSession, d: str) -> DataFrame:
    rows = encode.text_length(inputs.filled(spark, d))
    return rows.select("listing_id", F.col("len_desc").cast("long"), F.col("len_name").cast("long"))


def _stats_sql(t: str) -> str:
    words = f"len(list_filter(regexp_split_to_array({t}, '[\\s\\p{{Z}}]+'), lambda w: w <> ''))"
    upper = f"length(regexp_replace({t}, '[^\\p{{Lu}}]', '', 'g'))"
    alpha = f"length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g'))"
    ratio = lambda n: f"round(coalesce(length({t}) / nullif({n}, 0)::DOUBLE, 0), 6)"
    return (
        f"CAST({words} AS BIGINT) AS n_words, CAST({upper} AS BIGINT) AS n_upper, "
        f"CAST({alpha} AS BIGINT) AS n_alpha, CAST(length({t}) AS BIGINT) AS n_chars, "
        f"{ratio(words)} AS mean_len_words, {ratio(upper)} AS mean_upper, {ratio(alpha)} AS mean_alpha"
    )


@query(
    over(
        ["filled", "docs"],
        f"""SELECT listing_id, {_stats_sql('name')} FROM filled
            UNION ALL SELECT 'doc-' || listing_id, {_stats_sql('item_description')} FROM docs""",
    )
)
def text_stats(spark: SparkSession, d: str) -> DataFrame:
    def measured(df: DataFrame, column: str) -> DataFrame:
        return df.select(
            "listing_id",
            *[
                (c.cast("long") if n.startswith("n_") else F.round(c, 6)).alias(n)
                for n, c in tx.text_stats(F.col(column)).items()
            ],
        )

    docs = fixtures.documents(spark, d).withColumn("listing_id", F.concat(F.lit("doc-"), "listing_id"))
    return measured(inputs.filled(spark, d), "name").unionByName(measured(docs, "item_description"))


@query(
    "SELECT CAST(p_partkey AS VARCHAR) AS listing_id, array_to_string(list_transform(range(1, 33), "
    "lambda i: greatest(unicode(substr(p_name, i, 1)), 0)), ' ') AS codes FROM part"
)
def char_codes(spark: SparkSession, d: str) -> DataFrame:
    codes = tx.char_codes(F.col("p_name"), 32)
    return fixtures.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("listing_id"),
        F.array_join(F.transform(codes, lambda c: c.cast("string")), " ").alias("codes"),
    )


RATIOS = {"mean_len_words": "n_words", "mean_upper": "n_upper", "mean_alpha": "n_alpha"}
RATIO_COLUMNS = [f"{t}_{r}" for t in ("name", "item_description") for r in RATIOS]


def _ratio_sql(t: str, ratio: str) -> str:
    counted = {
        "n_words": f"len(list_filter(string_split_regex({t}, '[\\s\\p{{Z}}]+'), lambda w: w <> ''))",
        "n_upper": f"length(regexp_replace({t}, '[^\\p{{Lu}}]', '', 'g'))",
        "n_alpha": f"length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g'))",
    }
    return f"coalesce(length({t}) / nullif({counted[RATIOS[ratio]]}, 0)::DOUBLE, 0)"


@query(
    over(
        "filled",
        "SELECT listing_id, "
        + ", ".join(f"round({scaled(c, f'lo_{c}', f'hi_{c}')}, 6) AS {c}" for c in RATIO_COLUMNS)
        + " FROM ratios, bounds",
        ratios="SELECT listing_id, split, "
        + ", ".join(f"{_ratio_sql(t, r)} AS {t}_{r}" for t in ("name", "item_description") for r in RATIOS)
        + " FROM filled",
        bounds="SELECT "
        + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in RATIO_COLUMNS)
        + " FROM ratios WHERE split = 'train'",
    )
)
def length_ratio_norm(spark: SparkSession, d: str) -> DataFrame:
    """The three ratios of both texts, scaled by their ranges on training rows."""
    rows = inputs.filled(spark, d)
    measured = {t: tx.text_stats(F.col(t)) for t in ("name", "item_description")}
    ratios = publish(
        rows.select("listing_id", "split", *[measured[t][r].alias(f"{t}_{r}") for t in measured for r in RATIOS]),
        "ratios",
    )
    ranges = publish(stats.min_max(ratios.where("split = 'train'"), RATIO_COLUMNS), "ranges")
    out = encode.minmax_scale(ratios, ranges, RATIO_COLUMNS)
    return out.select("listing_id", *[F.round(c, 6).alias(c) for c in RATIO_COLUMNS])

"""Registered queries: price models and streams."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.functions.words import FALLBACK_PRICE
from tagwright.operators import clean, encode, linear, match, models, sparse, stats
from tagwright.operators.sparse_model import SparsePricer, fit_encoding
from tagwright.plans import inputs
from tagwright.plans.oracles import over
from tagwright.plans.registry import query
from tagwright.plans.statistics import RANGES, SCALED, rounded
from tagwright.sources import fixtures
from tagwright.sources import listings as src
from tagwright.sources.listings import is_test, is_train
from tagwright.sources.shared import fresh_path, publish
from tagwright.streaming import scoring

# ---- sparse models ----------------------------------------------------------------------------


def ridge_rows(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned listings with filled brands, cross keys and enriched texts."""
    unified = inputs.unified(spark, d)
    brands = publish(match.brand_dictionary(unified), "brands")
    return clean.enrich_name_desc(clean.cross_keys(clean.with_categories4(match.brand_fill(unified, brands))))


def ridge_blocks() -> list[sparse.Block]:
    whole = ["brand_name", "gencat_cond", "subcat_1_cond", "subcat_2_cond"]
    codes = sparse.onehot_codes(F.col("has_brand"), F.col("shipping"), F.col("item_condition_id"))
    return [
        sparse.hash_vectorize("name", F.col("name"), 2),
        sparse.category_tokens(F.col("category_name")),
        *[sparse.count_whole_value(c, F.col(c)) for c in whole],
        *codes,
        sparse.hash_vectorize("desc", F.col("item_description"), 3),
    ]


# The most frequent values kept per column; what is rarer becomes "missing".
LINEAR_TOPS = {"brand_name": 4500, "general_cat": 1250, "subcat_1": 1250, "subcat_2": 1250}


def linear_rows(spark: SparkSession, d: str) -> DataFrame:
    """Listings with rare brands and categories cut. Training rows below the least price lose their
    price: their texts count for the features, but nothing is learned from them."""
    rows = clean.split_low_price(fixtures.listings(spark, d))
    rows = clean.fill_missing_tag(clean.with_categories(rows)).fillna("missing", ["name"])
    return stats.topk_keep(rows, LINEAR_TOPS, rows.where(is_train()))


def linear_blocks() -> list[sparse.Block]:
    return [
        *sparse.dummies(F.col("item_condition_id"), F.col("shipping")),
        sparse.wordbag_desc(F.col("item_description")),
        sparse.onehot("brand", F.col("brand_name")),
        *[sparse.count_category_words(c, F.col(c)) for c in clean.LEVELS],
        sparse.wordbag_name(F.col("name")),
    ]


def learned(vectors: DataFrame) -> DataFrame:
    return vectors.where(is_train() & F.col("log_price").isNotNull())


def model_vectors(
    rows: DataFrame, blocks: list[sparse.Block], tfidf: bool, both_splits: bool
) -> DataFrame:
    """Vectors ``(listing_id, split, log_price, features)``.

    The blocks are written once, one row per listing, and counted once; its row then gives a listing's
    vector by the fitted features. A listing without a label is nothing to learn from.
    ``both_splits`` leaves out of the vectors what does not occur in train and test rows alike.
    """
    labelled = rows.withColumn("log_price", clean.log_price(F.col("price")))
    extra = ["split", "log_price"]
    stacked = publish(sparse.stack_rows(labelled, blocks, extra), "features")
    fitted = sparse.fit_stacked(stacked, blocks, both_splits)
    number = stacked.count() if tfidf else None
    return sparse.stacked_vectors(stacked, blocks, fitted, number, extra)


def scored(model, rows: DataFrame) -> DataFrame:
    found = models.score(model, rows.where(is_test()))
    return found.withColumn("price", clean.clip_negative(F.expm1("prediction")))


def linear_vectors(spark: SparkSession, d: str) -> DataFrame:
    return model_vectors(linear_rows(spark, d), linear_blocks(), tfidf=False, both_splits=False)


def ridge_vectors(spark: SparkSession, d: str) -> DataFrame:
    return model_vectors(ridge_rows(spark, d), ridge_blocks(), tfidf=True, both_splits=True)


@query()
def ridge_price(spark: SparkSession, d: str) -> DataFrame:
    vectors = ridge_vectors(spark, d)
    return scored(models.ridge_price(learned(vectors)), vectors)


@query()
def sparse_linear_price(spark: SparkSession, d: str) -> DataFrame:
    vectors = linear_vectors(spark, d)
    return scored(models.sparse_linear_price(learned(vectors)), vectors)


@query()
def fm_price(spark: SparkSession, d: str) -> DataFrame:
    vectors = linear_vectors(spark, d)
    return scored(models.fm_price(learned(vectors)), vectors)


WORD_COUNTS = """SELECT listing_id, split, '{c}' AS block, unnest(list_distinct(
    regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{2,}}'))) AS feature FROM tagged"""


@query(
    over(
        "tagged",
        """SELECT block, count(*) AS n_features, TRUE AS optimal FROM (
             SELECT block, feature FROM cells WHERE split = 'train' GROUP BY 1, 2) GROUP BY 1""",
        cells=" UNION ALL ".join(
            [
                *[WORD_COUNTS.format(c=c) for c in clean.LEVELS],
                "SELECT listing_id, split, 'brand', brand_name FROM tagged",
                "SELECT listing_id, split, 'cond', CAST(item_condition_id AS VARCHAR) FROM tagged",
                "SELECT listing_id, split, 'shipping', 'shipping' FROM tagged WHERE shipping <> 0",
            ]
        ),
    )
)
def sparse_linear_table(spark: SparkSession, d: str) -> DataFrame:
    """The same regression with its coefficients as a table, on category words, brand, condition and
    shipping. Per block: its features, and whether the conditions of an optimum hold for all of them
    (the slope of the squared error is what the penalty allows), computed from the predictions."""
    l1, l2 = 0.001, 0.01
    rows = inputs.tagged(spark, d).where(is_train())
    blocks = [
        *sparse.dummies(F.col("item_condition_id"), F.col("shipping")),
        sparse.onehot("brand", F.col("brand_name")),
        *[sparse.count_category_words(c, F.col(c)) for c in clean.LEVELS],
    ]
    long = publish(sparse.stack_blocks(rows, blocks, carry=["split"]), "features")
    fitted = sparse.fit_features(long, 1)
    cells = publish(sparse.indexed(long, fitted), "cells")
    labels = publish(rows.select("listing_id", clean.log_price(F.col("price")).alias("label")), "labels")
    model = linear.fit_table(cells, labels, l1, l2, passes=40, tol=1e-3)
    gaps = model.predict(cells, labels).join(labels, "listing_id").select("listing_id", (F.col("prediction") - F.col("label")).alias("gap"))
    facts = labels.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("sd")).first()
    slopes = cells.join(gaps, "listing_id").groupBy("index").agg((F.sum(F.col("value") * F.col("gap")) / facts["n"]).alias("slope"))
    w, slope = F.col("weight"), F.col("slope")
    miss = F.when(w == 0, F.abs(slope) - l1).otherwise(F.abs(slope + l2 * w + l1 * F.signum(w)))
    near = miss < 0.01 * facts["sd"]
    return (
        fitted.join(model.coefficients.select("index", "weight"), "index")
        .join(slopes, "index")
        .groupBy("block")
        .agg(F.count(F.lit(1)).alias("n_features"), F.every(near).alias("optimal"))
    )


# ---- stored sparse models ---------------------------------------------------------------------


def as_arrived(rows: DataFrame) -> DataFrame:
    """What is done to every listing before its sparse features are made."""
    return clean.fill_missing_tag(clean.with_categories(rows)).fillna("missing", ["name"])


def sparse_pricer(train: DataFrame) -> SparsePricer:
    """Encoding and L1 + L2 regression fitted on training listings only."""
    label = clean.log_price(F.col("price")).alias("log_price")
    rows = publish(as_arrived(clean.split_low_price(train)).select("*", label), "sparse-train")
    encoding, stacked = fit_encoding(rows, linear_blocks(), LINEAR_TOPS, extra=["log_price"])
    tagged = stacked.where(F.col("log_price").isNotNull())
    model = models.sparse_linear_price(encoding.apply(tagged, ["log_price"]))
    return SparsePricer(encoding, PipelineModel(stages=[model]), as_arrived)


EVERY_LISTING = over("listings", "SELECT listing_id, TRUE AS same FROM listings WHERE split = 'test'")


@query(EVERY_LISTING)
def stream_score_sparse(spark: SparkSession, d: str) -> DataFrame:
    """The sparse encoding and its model are stored and loaded again; arriving listings are priced file
    by file. ``same``: the price is that of one batch over all of them."""
    listings = fixtures.listings(spark, d)
    path = fresh_path(spark, "pricer")
    sparse_pricer(listings.where(is_train())).save(path)
    pricer = SparsePricer.load(spark, path, linear_blocks(), as_arrived)

    def price(batch: DataFrame) -> DataFrame:
        found = clean.clip_negative(F.expm1("prediction"))
        return pricer.score(batch.drop("price")).select("listing_id", clean.fallback_price(found, FALLBACK_PRICE).alias("price"))

    sink = scoring.stream_score(spark, arriving(spark, d, 3), price)
    streamed = src.read_predictions(spark, f"{sink}/batch=*")
    whole = price(listings.where(is_test())).withColumnRenamed("price", "whole")
    return streamed.join(whole, "listing_id").select(
        "listing_id", (F.abs(F.col("price") - F.col("whole")) < 1e-6).alias("same")
    )


@query()
def holdout_rmsle(spark: SparkSession, d: str) -> DataFrame:
    """The error of every model on the fold of training listings held out by hash, beside that of the
    mean of the others: ``(model, n, rmsle, constant)``. All is fitted on the other folds."""
    folds = encode.train_valid_split(fixtures.listings(spark, d).where(is_train() & (F.col("price") > 0)), 10)
    split = F.when(F.col("fold") == "valid", "test").otherwise("train")
    listings = publish(folds.withColumn("split", split).drop("fold"), "folds")
    rows = stats.topk_keep(as_arrived(clean.split_low_price(listings)), LINEAR_TOPS, as_arrived(listings.where(is_train())))
    vectors = model_vectors(rows, linear_blocks(), tfidf=False, both_splits=False)
    parts = {
        "linear": scored(models.sparse_linear_price(learned(vectors)), vectors),
        "fm": scored(models.fm_price(learned(vectors)), vectors),
    }
    filled = clean.fill_missing_dense(listings).withColumn("log_price", clean.log_price(F.col("price")))
    dense = encode.fit_dense(filled.where(is_train())).apply(filled)
    parts["dense"] = dense_scored(publish(dense, "dense"))
    actual = listings.where(is_test()).select("listing_id", F.col("price").alias("actual"))
    mean = listings.where(is_train()).agg(F.avg(F.log1p("price"))).scalar()
    gap = lambda x: F.sqrt(F.avg(F.pow(x - F.log1p("actual"), F.lit(2.0))))
    return stats.union_splits(
        *[
            found.join(actual, "listing_id").agg(
                F.lit(name).alias("model"), F.count(F.lit(1)).alias("n"),
                F.round(gap(F.log1p("price")), 4).alias("rmsle"), F.round(gap(mean), 4).alias("constant"),
            )
            for name, found in parts.items()
        ]
    )


# ---- dense models -----------------------------------------------------------------------------


def dense_rows(spark: SparkSession, d: str) -> DataFrame:
    """Encoded and scaled listings, written once for the passes of the fit."""
    narrow = encode.narrowed(inputs.filled(spark, d), "listing_id", "split", "price", "log_price")
    rows = encode.fit_dense(narrow.where(is_train())).apply(narrow)
    keep = ["listing_id", "split", "item_condition_id", "shipping", "price", "log_price", *encode.DENSE]
    return publish(rows.select(*keep), "dense")


def dense_scored(rows: DataFrame) -> DataFrame:
    """Prices of the test rows by boosted trees on the standardised label."""
    moments = publish(stats.global_moments(rows.where(is_train()), "log_price"), "moments")
    target = encode.standardize(rows, moments, "log_price", "z")
    model = models.dense_price(target.where(is_train()), label="z")
    found = models.score(model, models.with_condition(rows.where(is_test())), "z")
    back = encode.unstandardize(found, moments, "z", "prediction")
    return back.select("listing_id", "prediction", clean.clip_negative(F.expm1("prediction")).alias("price"))


@query()
def dense_price(spark: SparkSession, d: str) -> DataFrame:
    return dense_scored(dense_rows(spark, d))


EVERY_TEST_LISTING = over("test", "SELECT listing_id, TRUE AS same FROM test")


@query(EVERY_TEST_LISTING)
def score_batches(spark: SparkSession, d: str) -> DataFrame:
    """The fitted model is stored; a reader of the stored model prices the unseen rows batch by
    batch. ``same``: the price equals that of the model in hand over all rows at once."""
    rows = dense_rows(spark, d)
    path = fresh_path(spark, "model")
    model = models.dense_price(rows.where(is_train()))
    model.write().save(path)
    stored, test = PipelineModel.load(path), models.with_condition(rows.where(is_test()))
    batches = [test.where(encode.hash_percent(F.col("listing_id")) % 4 == i) for i in range(4)]
    found = stats.union_splits(*[models.score(stored, batch) for batch in batches])
    whole = models.score(model, test, "whole")
    return found.join(whole, "listing_id").select(
        "listing_id", (F.col("prediction") == F.col("whole")).alias("same")
    )


SWEEP_STEPS, SWEEP_ITERS = [0.1, 0.3], [5, 20]


@query(
    "SELECT s.step, i.iters, TRUE AS finite FROM (SELECT unnest([0.1::DOUBLE, 0.3::DOUBLE]) AS step) s, "
    "(SELECT unnest([5::INT, 20::INT]) AS iters) i"
)
def schedule_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The grid of step sizes and rounds, each fitted on the training fold (encodings too) and
    measured on the fold held out by hash."""
    folds = encode.train_valid_split(inputs.train(spark, d))
    fitted = encode.fit_dense(folds.where("fold = 'train'"))
    keep = ["listing_id", "fold", "item_condition_id", "shipping", "price", "log_price", *encode.DENSE]
    rows = publish(fitted.apply(folds).select(*keep), "folds")
    errors = models.schedule_sweep(
        rows.where("fold = 'train'"), rows.where("fold = 'valid'"), SWEEP_STEPS, SWEEP_ITERS
    )
    finite = F.col("rmsle").isNotNull() & ~F.isnan("rmsle") & (F.col("rmsle") < 10)
    return errors.select("step", "iters", finite.alias("finite"))


# ---- the price list ---------------------------------------------------------------------------


PRICE_LIST = over("listings", "SELECT listing_id, TRUE AS sound, TRUE AS is_blend FROM listings WHERE split = 'test'")


def price_list(spark: SparkSession, d: str, weights: dict[str, float], parts: dict[str, DataFrame]) -> DataFrame:
    """Prices blended from several models, with the fallback, written as CSV and read back.

    ``sound``: the price read is a number and not negative. ``is_blend``: it is the weighted mean of
    the models' own prices, as far as they have one, to four digits.
    """
    stored = {k: publish(v.select("listing_id", F.col("prediction").alias(k)), k) for k, v in parts.items()}
    wanted = fixtures.listings(spark, d).where(is_test()).select("listing_id")
    joined = publish(encode.join_predictions(wanted, *stored.values(), how="left"), "parts")
    price = clean.fallback_price(clean.clip_negative(encode.blend(weights)), FALLBACK_PRICE)
    path = src.write_predictions(joined.select("listing_id", price.alias("price")), fresh_path(spark, "prices"))
    read = src.read_predictions(spark, path)
    mean = sum((F.greatest(F.expm1(F.col(k)), F.lit(-1.0)) * w for k, w in weights.items()), F.lit(0.0))
    again = F.greatest(F.coalesce(mean, F.lit(FALLBACK_PRICE)), F.lit(0.0))
    both = read.join(joined, "listing_id")
    return both.select(
        "listing_id",
        (F.col("price").isNotNull() & ~F.isnan("price") & (F.col("price") >= 0)).alias("sound"),
        (F.abs(F.col("price") - again) < 1e-4).alias("is_blend"),
    )


@query(PRICE_LIST)
def blended_prices(spark: SparkSession, d: str) -> DataFrame:
    """Three models: 0.10 of the linear one, 0.60 of the trees, 0.30 of the factorisation machine."""
    vectors = linear_vectors(spark, d)
    parts = {
        "linear": scored(models.sparse_linear_price(learned(vectors)), vectors),
        "fm": scored(models.fm_price(learned(vectors)), vectors),
        "dense": dense_scored(dense_rows(spark, d)),
    }
    return price_list(spark, d, {"linear": 0.10, "dense": 0.60, "fm": 0.30}, parts)


@query(PRICE_LIST)
def blended_prices_ridge(spark: SparkSession, d: str) -> DataFrame:
    """Two models: 0.40 of the ridge regression, 0.60 of the trees."""
    vectors = ridge_vectors(spark, d)
    parts = {
        "ridge": scored(models.ridge_price(learned(vectors)), vectors),
        "dense": dense_scored(dense_rows(spark, d)),
    }
    return price_list(spark, d, {"ridge": 0.40, "dense": 0.60}, parts)


# ---- streams ----------------------------------------------------------------------------------


def arriving(spark: SparkSession, d: str, files: int) -> str:
    """The listings to be priced, as files of a folder."""
    path = fresh_path(spark, "arriving")
    fixtures.listings(spark, d).where(is_test()).repartition(files).write.parquet(path)
    return path


@query(over("dense", f"SELECT listing_id, {SCALED} FROM dense, ranges WHERE split = 'test'", ranges=RANGES))
def stream_features(spark: SparkSession, d: str) -> DataFrame:
    fitted = encode.fit_dense(inputs.train(spark, d))

    def features(batch: DataFrame) -> DataFrame:
        return fitted.apply(clean.fill_missing_dense(batch)).select("listing_id", *encode.DENSE)

    sink = scoring.stream_features(spark, arriving(spark, d, 3), features)
    return spark.read.parquet(sink).select("listing_id", *rounded(*encode.DENSE))


@query(EVERY_TEST_LISTING)
def stream_score(spark: SparkSession, d: str) -> DataFrame:
    """Prices of arriving listings, against those of one batch over all of them (``same``)."""
    narrow = encode.narrowed(inputs.train(spark, d), "log_price")
    fitted = encode.fit_dense(narrow)
    train = publish(fitted.apply(narrow), "dense")
    model = models.dense_price(train)

    def price(batch: DataFrame) -> DataFrame:
        rows = models.with_condition(fitted.apply(clean.fill_missing_dense(batch)))
        found = F.expm1(F.col("prediction"))
        return model.transform(rows).select(
            "listing_id", clean.fallback_price(clean.clip_negative(found), FALLBACK_PRICE).alias("price")
        )

    sink = scoring.stream_score(spark, arriving(spark, d, 3), price)
    streamed = src.read_predictions(spark, f"{sink}/batch=*")
    whole = price(fixtures.listings(spark, d).where(is_test())).withColumnRenamed("price", "whole")
    return streamed.join(whole, "listing_id").select(
        "listing_id", (F.abs(F.col("price") - F.col("whole")) < 1e-6).alias("same")
    )

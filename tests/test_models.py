"""Models on listings whose price is known to follow brand and condition."""

import pytest
from pyspark.sql import functions as F

from tagwright.operators import clean, encode, models
from tagwright.plans import pricing
from tagwright.sources.shared import fresh_path, publish


@pytest.fixture(scope="module")
def planted(spark):
    """Brand b costs about 2 ** b, worse conditions less, shipping a little more."""
    brand, condition = F.col("id") % 6, F.col("id") % 5 + 1
    noise = (F.pmod(F.xxhash64("id"), F.lit(100)) / 100 - 0.5) * 0.2
    price = F.exp(F.lit(1.0) + brand * 0.7 - condition * 0.15 + (F.col("id") % 2) * 0.1 + noise)
    rows = spark.range(600).select(
        F.col("id").cast("string").alias("listing_id"),
        F.when(F.col("id") % 7 == 0, "test").otherwise("train").alias("split"),
        F.concat(F.lit("brandname"), brand, F.lit(" thing number"), F.col("id") % 11).alias("name"),
        F.concat(F.lit("cat/sub"), F.col("id") % 3, F.lit("/leaf")).alias("category_name"),
        F.concat(F.lit("brand"), brand).alias("brand_name"),
        F.concat(F.lit("some words about brandname"), brand).alias("item_description"),
        condition.cast("int").alias("item_condition_id"),
        (F.col("id") % 2).cast("int").alias("shipping"),
        price.alias("price"),
    )
    return publish(rows, "planted")


def errors(spark, rows, found):
    """RMSLE of the prices found and of the train mean, on the test rows."""
    test = rows.where("split = 'test'").select("listing_id", F.col("price").alias("actual"))
    guess = rows.where("split = 'train'").agg(F.avg(F.log1p("price"))).first()[0]
    both = test.join(found.select("listing_id", "price"), "listing_id")
    assert both.count() == test.count()
    gap = lambda x: F.sqrt(F.avg(F.pow(x - F.log1p("actual"), F.lit(2.0))))
    return both.agg(gap(F.log1p("price")), gap(F.lit(guess))).first()


@pytest.mark.parametrize("fit", [models.ridge_price, models.sparse_linear_price, models.fm_price])
def test_sparse_models_find_the_signal(spark, planted, fit):
    rows = clean.split_low_price(planted)
    rows = clean.fill_missing_tag(clean.with_categories(rows))
    vectors = pricing.model_vectors(rows, pricing.linear_blocks(), tfidf=False, both_splits=False)
    found = pricing.scored(fit(pricing.learned(vectors)), vectors)
    model, constant = errors(spark, planted, found)
    assert model < 0.5 * constant


def test_dense_model_finds_the_signal(spark, planted):
    rows = planted.withColumn("log_price", clean.log_price(F.col("price")))
    fitted = encode.fit_dense(rows.where("split = 'train'"))
    model, constant = errors(spark, planted, pricing.dense_scored(publish(fitted.apply(rows), "rows")))
    assert model < 0.4 * constant


def test_sweep_prefers_more_rounds(spark, planted):
    rows = planted.withColumn("log_price", clean.log_price(F.col("price")))
    fitted = encode.fit_dense(rows.where("split = 'train'"))
    all_rows = publish(fitted.apply(rows), "rows")
    grid = models.schedule_sweep(
        all_rows.where("split = 'train'"), all_rows.where("split = 'test'"), [0.1], [1, 20]
    ).collect()
    by_rounds = {r["iters"]: r["rmsle"] for r in grid}
    assert set(by_rounds) == {1, 20} and by_rounds[20] < by_rounds[1]


def test_sweep_equals_separate_fits(spark, planted):
    """The first trees of an ensemble are the ensemble of fewer rounds."""
    from pyspark.ml.regression import GBTRegressor

    rows = planted.withColumn("log_price", clean.log_price(F.col("price")))
    rows = publish(encode.fit_dense(rows.where("split = 'train'")).apply(rows), "rows")
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    got = {(r["step"], r["iters"]): r["rmsle"] for r in models.schedule_sweep(train, test, [0.1, 0.3], [2, 5]).collect()}
    assembler = models.dense_assembler()
    for (step, rounds), error in got.items():
        trees = GBTRegressor(featuresCol="features", labelCol="log_price", maxIter=rounds, stepSize=step, maxDepth=5, seed=100)
        model = trees.fit(assembler.transform(models.with_condition(train)))
        found = model.transform(assembler.transform(models.with_condition(test))).withColumn("p", F.expm1("prediction"))
        assert encode.rmsle(found, "price", "p").first()["rmsle"] == pytest.approx(error, abs=1e-9)


def test_without_a_signal_the_machine_is_the_mean(spark, planted):
    """Prices by hash: nothing to learn."""
    noise = F.exp(F.pmod(F.xxhash64(F.lit("x"), "listing_id"), F.lit(1000)) / 200.0)
    rows = planted.withColumn("price", noise)
    cut = clean.fill_missing_tag(clean.with_categories(clean.split_low_price(rows)))
    vectors = pricing.model_vectors(cut, pricing.linear_blocks(), tfidf=False, both_splits=False)
    model, constant = errors(spark, rows, pricing.scored(models.fm_price(pricing.learned(vectors), budgets=(25, 50)), vectors))
    assert model < 1.03 * constant


@pytest.mark.parametrize("l1,l2,limit", [(0.02, 0.1, None), (0.0, 0.05, 0), (0.05, 0.0, None)])
def test_coefficient_table_reaches_the_same_optimum(spark, l1, l2, limit):
    """Against the library's solver on a small dense problem with correlated features and a listing
    without cells; the same by broadcast and by shuffle of the coefficients."""
    import numpy as np
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import LinearRegression

    from tagwright.operators import linear

    rng = np.random.default_rng(4)
    x = (rng.random((120, 6)) < 0.5) * rng.normal(1, 0.3, (120, 6))
    x[:, 1] = x[:, 0] * 0.8 + (x[:, 1] > 0) * 0.3
    x[7] = 0
    y = 3 + x @ np.array([1.5, -1.0, 0.0, 0.6, 0.02, 0.0]) + rng.normal(0, 0.2, 120)
    cells = spark.createDataFrame([(str(i), j, float(x[i, j])) for i in range(120) for j in range(6)], "listing_id string, index long, value double")
    labels = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate(y)], "listing_id string, label double")
    model = linear.fit_table(cells, labels, l1, l2, passes=80, tol=1e-3, limit_bytes=limit)
    sd = y.std(ddof=1)
    reg = l1 + l2 * sd  # the library's L2 is in units of the label's deviation
    dense = spark.createDataFrame([(Vectors.dense(r), float(v)) for r, v in zip(x, y)], ["features", "label"])
    other = LinearRegression(regParam=reg, elasticNetParam=l1 / reg, standardization=False, maxIter=500, tol=1e-10).fit(dense)
    got = {r["index"]: r["weight"] for r in model.coefficients.collect()}
    assert np.allclose([got[j] for j in range(6)], other.coefficients.toArray(), atol=0.02)
    assert model.intercept == pytest.approx(other.intercept, abs=0.03)
    found = {r.listing_id: r.prediction for r in model.predict(cells, labels).collect()}
    assert len(found) == 120 and found["7"] == pytest.approx(model.intercept)


def test_stored_encoding_gives_the_same(spark, planted):
    rows = planted.withColumn("log_price", clean.log_price(F.col("price")))
    fitted = encode.fit_dense(rows.where("split = 'train'"), unseen="global_mean")
    path = fresh_path(spark, "encoding")
    fitted.save(path)
    again = encode.DenseEncoding.load(spark, path)
    new = rows.where("split = 'test'").withColumn("brand_name", F.lit("never seen"))
    columns = ["listing_id", *encode.DENSE]
    assert sorted(fitted.apply(new).select(columns).collect()) == sorted(again.apply(new).select(columns).collect())


def test_features_fitted_on_train_score_unseen_rows(spark, planted):
    """A fitted table of features is applied to rows that were not there when it was made."""
    from tagwright.operators import sparse

    rows = clean.fill_missing_tag(clean.with_categories(clean.split_low_price(planted)))
    blocks = pricing.linear_blocks()
    train = sparse.stack_blocks(rows.where("split = 'train'"), blocks, carry=["split"])
    fitted = sparse.fit_features(train, {b.name: b.min_df for b in blocks})
    cells = sparse.indexed(sparse.stack_blocks(rows.where("split = 'test'"), blocks), fitted)
    assert cells.count() > 0
    assert cells.join(fitted, "index", "left_anti").count() == 0


def test_a_model_too_wide_is_refused(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    monkeypatch.setattr(models, "MAX_COEFFICIENTS", 100)
    wide = spark.createDataFrame([(Vectors.sparse(101, {1: 1.0}), 1.0)], ["features", "log_price"])
    with pytest.raises(ValueError, match="101 coefficients"):
        models.sparse_linear_price(wide)


def test_tree_fits_deal_many_rows_over_more_tasks(spark, planted, monkeypatch):
    """No task holds more than its share, whatever the files' splits; the model still finds the signal."""
    rows = planted.withColumn("log_price", clean.log_price(F.col("price")))
    dense = publish(encode.fit_dense(rows.where("split = 'train'")).apply(rows), "rows").coalesce(1)
    assert models.dealt(dense, 600).rdd.getNumPartitions() == 1
    monkeypatch.setattr(models, "ROWS_PER_TASK", 60)
    parts = models.dealt(dense, 600)
    sizes = parts.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) < 120
    model, constant = errors(spark, planted, pricing.dense_scored(dense))
    assert model < 0.4 * constant
    found = models.schedule_sweep(dense.where("split = 'train'"), dense.where("split = 'test'"), [0.1, 0.3], [1, 3])
    assert sorted((r["step"], r["iters"]) for r in found.collect()) == [(0.1, 1), (0.1, 3), (0.3, 1), (0.3, 3)]


@pytest.fixture(scope="module")
def crossed(spark):
    """Rows whose label holds a product of two features; some rows are empty, one vector is dense."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(1)
    x = (rng.random((200, 9)) < 0.4) * rng.normal(1, 0.5, (200, 9))
    x[[0, 50, 199]] = 0
    y = x @ rng.normal(0, 1, 9) + x[:, 0] * x[:, 1] * 2 + 0.5
    sparse = [Vectors.sparse(9, [(int(j), float(r[j])) for j in np.flatnonzero(r)]) for r in x]
    sparse[3] = Vectors.dense(x[3])
    return spark.createDataFrame([(str(i), v, float(z)) for i, (v, z) in enumerate(zip(sparse, y))], ["listing_id", "features", "z"])


@pytest.mark.parametrize("decay,together,width", [(0.0, 1_000_000, 16_384), (0.3, 10, 4)])
def test_steps_are_those_of_the_library(spark, crossed, monkeypatch, decay, together, width):
    """From the same start, on all rows, in one stage or two, by small pieces and ranges too."""
    import numpy as np
    from pyspark.ml import regression

    from tagwright.operators import machine

    monkeypatch.setattr(machine, "TOGETHER", together)
    monkeypatch.setattr(machine, "RANGE", width)
    library = lambda n, step, reg: regression.FMRegressor(
        featuresCol="features", labelCol="z", factorSize=3, maxIter=n, stepSize=step, initStd=0.1, regParam=reg, solver="adamW", tol=0.0, seed=7
    ).fit(crossed)
    rank = machine.ranks(crossed)
    ours = machine.FMRegressor(3, 0.1, decay, 1.0, 7)
    ours.fit(crossed, 0)
    ours.machine.weights[:-1][:, rank] = library(1, 1e-15, 0.0).factors.toArray().T
    ours.fit(crossed, 2)
    found, other = ours.fit(crossed, 6), library(6, 0.1, decay)
    ours.release()
    assert np.allclose(found.weights[:-1][:, rank], other.factors.toArray().T, atol=1e-10)
    assert np.allclose(found.weights[-1][rank], other.linear.toArray(), atol=1e-10)
    assert found.intercept == pytest.approx(other.intercept, abs=1e-10)
    want = {r["listing_id"]: r["prediction"] for r in other.transform(crossed).collect()}
    got = {r["listing_id"]: r["p"] for r in found.transform(crossed, "p").collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_no_step_of_the_machine_is_made_twice(spark, crossed, monkeypatch):
    """The second budget goes on where the first ended: three steps, not five."""
    from tagwright.operators import machine

    made, gradients = [], machine.gradients
    monkeypatch.setattr(machine, "gradients", lambda *args: made.append(1) or gradients(*args))
    rows = crossed.withColumnRenamed("z", "log_price")
    model = models.fm_price(rows, budgets=(2, 3))
    assert len(made) == 3 and models.score(model, rows).count() == 200
    with pytest.raises(ValueError, match="nothing to learn from"):
        models.fm_price(rows.limit(0))
    with pytest.raises(ValueError, match="ascend"):
        models.fm_price(rows, budgets=(3, 2))


def test_stored_sparse_encoding_moves_no_cells(spark, planted, monkeypatch):
    """Training rows are hashed once, and no row's cells are joined or grouped to make its vector; the vectors
    are those of the long table."""
    from tagwright.operators import sparse
    from tagwright.operators.sparse_model import SparseEncoding, fit_encoding

    rows, blocks = pricing.as_arrived(clean.split_low_price(planted)), pricing.linear_blocks()
    train, new = rows.where("split = 'train'"), rows.where("split = 'test'")
    stacked, stack_rows = [], sparse.stack_rows
    with monkeypatch.context() as m:
        m.setattr(sparse, "stack_rows", lambda *args: stacked.append(1) or stack_rows(*args))
        for joins in ("indexed", "pack_vectors"):
            m.setattr(sparse, joins, None)
        encoding, own = fit_encoding(train, blocks, pricing.LINEAR_TOPS, extra=["price"])
        trained = encoding.apply(own, ["price"])
        assert len(stacked) == 1
        path = fresh_path(spark, "sparse")
        encoding.save(path)
        found = SparseEncoding.load(spark, path, blocks).apply(new)
        assert len(stacked) == 2 and found.columns == ["listing_id", "features"]
    assert trained.columns == ["listing_id", "price", "features"] and trained.count() == train.count()
    cells = sparse.indexed(sparse.stack_blocks(encoding.cut(new), blocks), encoding.features)
    want = {r[0]: r["features"] for r in sparse.pack_vectors(cells, encoding.features, new).collect()}
    assert {r[0]: r["features"] for r in found.collect()} == want and len(want) == new.count()


def test_training_listings_of_the_stream_are_made_once(spark, monkeypatch):
    from tagwright.plans import catalog, inputs

    made, train = [], inputs.train
    monkeypatch.setattr(inputs, "train", lambda *args: made.append(publish(train(*args), "train")) or made[-1])
    whole = []
    narrowed = encode.narrowed
    monkeypatch.setattr(encode, "narrowed", lambda rows, *columns: whole.append(rows) or narrowed(rows, *columns))
    assert catalog.QUERIES["stream_score"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(made) == 1 and whole == made  # their texts are read to be measured, and not again

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagwright.operators import clean, encode, lookup, models, sparse, stats
from tagwright.operators import vocab as vo
from tagwright.sources import listings as src
from tagwright.sources.shared import fresh_path, publish, shared_dir


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key; some keys are unknown or null."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 101 == 0, None).otherwise(
        F.concat(F.lit("k"), F.col("id") % 50)
    )
    return spark.range(3000).select(F.col("id").cast("string").alias("listing_id"), key.alias("key"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_lookup_is_the_same_by_broadcast_and_by_shuffle(spark, skewed, how):
    counted = skewed.where("key IS NOT NULL AND key != 'k7'").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    table = publish(counted.withColumn("value", F.length("key")), "t")
    small = lookup.lookup_join(skewed, table, "key", how, weight="n")
    big = lookup.lookup_join(skewed, table, "key", how, weight="n", limit_bytes=0)
    assert sorted(small.columns) == sorted(big.columns)
    columns = sorted(small.columns)
    assert sorted(map(str, small.select(columns).collect())) == sorted(map(str, big.select(columns).collect()))
    # Rows of the hot key and rows without a key are answered apart from the join by shuffle.
    plan = big._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "LeftAnti" in plan
    # What was measured as too big is not broadcast for its small files.
    plan = lookup.lookup_join(skewed, table, "key", how, limit_bytes=0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_index_does_not_depend_on_partitions(spark, parts):
    words = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("w")).repartition(parts)
    got = [r["w"] for r in lookup.dense_index(words, "w", "i").orderBy("i").collect()]
    assert got == sorted(got)
    assert lookup.dense_index(words, "w", "i").agg(F.min("i"), F.max("i"), F.countDistinct("i")).first()[:] == (1, 500, 500)


def test_shared_dir_is_the_cluster_setting(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_scratch_deletes_what_was_published(spark, tmp_path):
    import os

    from tagwright.sources.shared import scratch

    kept = publish(spark.range(3), "kept")
    with scratch(spark):
        gone = publish(spark.range(5), "gone")
        place = gone.inputFiles()[0]
        gone.write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5 and kept.count() == 3
    assert not os.path.exists(place.removeprefix("file://"))


def test_tsv_edge_cases(spark):
    path = fresh_path(spark, "tsv")
    text = 'listing_id\tname\tbrand_name\n1\t"a ""q"" b"\t\n2\tNA\tnan\n4\t"x\ty\nz"\tB\n'
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.text(path)
    schema = "listing_id string, name string, brand_name string"
    rows = {r["listing_id"]: (r["name"], r["brand_name"]) for r in src.read_listings(spark, path, schema).collect()}
    assert rows == {"1": ('a "q" b', None), "2": (None, None), "4": ("x\ty\nz", "B")}
    kept = {r["listing_id"]: r["name"] for r in src.read_listings(spark, path, schema, spellings=[""]).collect()}
    assert kept["2"] == "NA"


def tokens(spark, rows):
    return spark.createDataFrame(rows, "listing_id string, tokens array<string>")


def test_sequences_keep_empty_rows_and_order(spark):
    df = tokens(spark, [("1", ["b", "a", "b", "zz"]), ("2", []), ("3", ["zz2"]), ("4", ["a"])])
    vocab = publish(vo.vocab_fit(df, 2), "v")
    assert {r["token"]: r["idx"] for r in vocab.collect()} == {"a": 1}
    vocab = publish(vo.vocab_fit(df.where("listing_id != '2'"), 1), "v")
    got = {r["listing_id"]: r["indices"] for r in vo.sequence_encode(df, vocab).collect()}
    assert got == {"1": [2, 1, 2, 3], "2": [], "3": [4], "4": [1]}


def test_padding(spark):
    df = spark.createDataFrame([([5, 2, 9],), ([],)], "indices array<long>")
    got = [r[0] for r in df.select(vo.sequence_pad(F.col("indices"), 2)).collect()]
    assert got == [[5, 2], [0, 0]]


def test_embedding_of_nothing_is_zero(spark):
    vectors = publish(spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 0.0])], "word string, vec array<float>"), "w")
    df = tokens(spark, [("1", ["a", "a", "q"]), ("2", []), ("3", ["q"])])
    got = {r["listing_id"]: r["vec"] for r in vo.sentence_embedding(df, vectors, 2).collect()}
    assert got["2"] == got["3"] == [0.0, 0.0]
    assert got["1"] == pytest.approx([0.6, 0.8])


def test_blocks_are_normed_per_row_and_block(spark):
    df = spark.createDataFrame([("1", "red shoe red", "acme"), ("2", "", "")], "listing_id string, t string, b string")
    blocks = [sparse.wordbag_desc(F.col("t")), sparse.onehot("brand", F.col("b"))]
    rows = sparse.stack_blocks(df, blocks).collect()
    assert {r["listing_id"] for r in rows} == {"1"}
    assert sum(r["value"] ** 2 for r in rows if r["block"] == "desc") == pytest.approx(1.0)
    assert [r["value"] for r in rows if r["block"] == "brand"] == [1.0]


def test_vectors_carry_the_long_table(spark):
    df = spark.createDataFrame([(str(i), "w%d v%d" % (i % 3, i % 2)) for i in range(20)] + [("x", "")], "listing_id string, t string")
    features = publish(sparse.stack_blocks(df, [sparse.wordbag_name(F.col("t"))]), "f")
    index = publish(sparse.feature_index(sparse.kept_features(sparse.col_nnz(features), 2)), "i")
    vectors = sparse.to_vectors(features, index, df).collect()
    kept = sparse.df_filter(features, index)
    assert len(vectors) == 21
    assert sum(v["features"].numNonzeros() for v in vectors) == kept.count()
    assert sum(float(v["features"].values.sum()) for v in vectors) == pytest.approx(kept.agg(F.sum("value")).first()[0])


def test_smoothing_of_zero_is_the_mean(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 2.0)], "k string, y double")
    plain = {r["k"]: r["m"] for r in stats.group_mean(df, "k", "y", "m").collect()}
    smooth = {r["k"]: r["m"] for r in stats.smoothed_mean(df, "k", "y", "m").collect()}
    assert plain == smooth == {"a": 2.5, "b": 2.0}


def test_unseen_keys_are_zero_before_scaling(spark):
    schema = "listing_id string, category_name string, item_condition_id int, brand_name string, shipping int, name string, item_description string, log_price double"
    train = spark.createDataFrame(
        [("1", "a", 1, "x", 0, "n", "d", 2.0), ("2", "b", 2, "y", 1, "nn", "dd", 4.0)], schema
    )
    test = spark.createDataFrame([("3", "new", 1, "x", 0, "n", "d", None)], schema)
    assert encode.fit_dense(train).apply(test).first()["cat_mean"] == -3.0
    assert encode.fit_dense(train, unseen="global_mean").apply(test).first()["cat_mean"] == 0.0


def test_low_prices_only_count_for_text(spark):
    df = spark.createDataFrame(
        [("1", "train", 0.0), ("2", "train", 5.0), ("3", "test", 7.0)], "listing_id string, split string, price double"
    )
    got = {r["listing_id"]: (r["role"], r["price"]) for r in clean.split_low_price(df).collect()}
    assert got == {"1": ("vocab_only", None), "2": ("train", 5.0), "3": ("test", None)}


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = x @ np.array([0.5, -1.0, 0.2]) + 3 + rng.normal(size=200) * 0.1
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.dense(a), float(b)) for a, b in zip(x.tolist(), y.tolist())]
    model = models.ridge_price(spark.createDataFrame(rows, ["features", "log_price"]), alpha=0.4, tol=1e-10)
    xc, yc = x - x.mean(0), y - y.mean()
    exact = np.linalg.solve(xc.T @ xc + 0.4 * np.eye(3), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), exact, atol=1e-6)


@pytest.fixture(scope="module")
def priced(spark):
    rows = [(str(i), f"c{i % 7}", i % 5, "rare" if i == 3 else f"b{i % 3}", i % 2, float(i % 11)) for i in range(200)]
    return spark.createDataFrame(
        rows, "listing_id string, category_name string, item_condition_id int, brand_name string, shipping int, log_price double"
    )


def test_states_of_any_chunks_merge_to_one_fit(spark, priced):
    whole = stats.partial_state(priced, "log_price")
    key = lambda df: sorted(map(str, df.collect()))
    for cuts in ([1], [3, 7], [2, 2, 5, 11]):
        state = stats.partial_state(priced.where("false"), "log_price")
        for i, n in enumerate([*cuts, 13]):
            rows = priced.where(F.pmod(F.xxhash64("listing_id"), F.lit(len(cuts) + 1)) == i).repartition(n)
            state = stats.merge_states(state, stats.partial_state(rows, "log_price"))
        assert key(state.select(whole.columns)) == key(whole)
    means = {(r["feature"], r["key"]): r["mean"] for r in stats.state_means(whole).collect()}
    assert means == pytest.approx({(r["feature"], r["key"]): r["mean"] for r in stats.group_means(priced, "log_price").collect()})
    assert key(stats.state_counts(whole, "brand_name")) == key(stats.value_counts(priced, "brand_name"))
    for column in ("brand_name", "shipping"):
        assert stats.state_range(whole, column).first()[:] == (0.0, 10.0)


def test_out_of_fold_means_do_not_see_their_row(spark, priced):
    rows = {r.listing_id: r for r in encode.out_of_fold(priced, "log_price", 4).collect()}
    folds = {r[0]: r[1] for r in priced.select("listing_id", encode.fold_of(F.col("listing_id"), 4)).collect()}
    for r in rows.values():
        others = [x.log_price for x in rows.values() if x.brand_name == r.brand_name and folds[x.listing_id] != folds[r.listing_id]]
        assert r.brand_mean == pytest.approx(sum(others) / len(others) if others else 0.0)
    assert rows["3"].brand_mean == 0.0  # its value is in its own fold only
    leaky = {r.listing_id: r.brand_mean for r in encode.out_of_fold(priced, "log_price", leaky=True).collect()}
    means = stats.group_means(priced, "log_price")
    plain = encode.join_left_stats(priced, means).select("listing_id", "brand_mean").collect()
    assert leaky == pytest.approx({r[0]: r[1] for r in plain})


@pytest.mark.parametrize("rows", [None, 31])
@pytest.mark.parametrize("both", [False, True])
@pytest.mark.parametrize("most", [sparse.PLACES, 0])
def test_rows_of_their_own_make_the_vectors_of_the_long_table(spark, rows, both, most):
    texts = [("red w%d v%d" % (i % 3, i % 2), "b%d" % (i % 4), "train" if i % 5 else "test") for i in range(30)]
    texts += [("", "", "train"), (None, None, "train"), ("only here", "x", "train"), ("only here", "x", "train")]
    data = [(str(i), *t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "listing_id string, t string, b string, split string")
    blocks = [sparse.wordbag_desc(F.col("t")), sparse.onehot("brand", F.col("b")), sparse.wordbag_name(F.col("t"))]
    long = publish(sparse.stack_blocks(df, blocks, ["split"]), "f")
    fitted = sparse.fit_features(long, {b.name: b.min_df for b in blocks}, both)
    want = {r[0]: r["features"] for r in sparse.pack_vectors(sparse.indexed(long, fitted, rows), fitted, df).collect()}
    stacked = publish(sparse.stack_rows(df, blocks, ["split"]), "s")
    again = sparse.fit_stacked(stacked, blocks, both)
    assert sorted(map(str, again.collect())) == sorted(map(str, fitted.select(again.columns).collect()))
    found = sparse.stacked_vectors(stacked, blocks, again, rows, ["split"], most).collect()
    assert len(found) == len(want) == len(data)
    for r in found:
        own = want[r["listing_id"]]
        assert r["split"] == data[int(r["listing_id"])][3] and r["features"].size == own.size
        assert r["features"].indices.tolist() == own.indices.tolist()
        assert r["features"].values == pytest.approx(own.values, rel=1e-12)


def test_factorisation_adds_up_one_gradient_per_share_of_rows(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    rows = spark.range(400).rdd.map(lambda r: (str(r.id), float(r.id % 3), Vectors.sparse(5, [r.id % 5], [1.0])))
    rows = rows.toDF(["listing_id", "log_price", "features"]).repartition(40)
    seen, fit = [], models.FMRegressor.fit

    def counted(self, df, *args):
        seen.append(df.rdd.getNumPartitions())
        return fit(self, df, *args)

    monkeypatch.setattr(models.FMRegressor, "fit", counted)
    monkeypatch.setattr(models, "publish_vectors", lambda df, label: df)
    monkeypatch.setattr(models, "ROWS_PER_TASK", 200)
    models.fm_price(rows, budgets=(2, 3))
    assert seen == [spark.sparkContext.defaultParallelism] * 2


def test_narrowed_rows_are_encoded_like_whole_ones(spark):
    rows = spark.range(200).select(
        F.col("id").cast("string").alias("listing_id"), F.concat(F.lit("c"), F.col("id") % 7).alias("category_name"),
        (F.col("id") % 5).cast("int").alias("item_condition_id"), F.concat(F.lit("b"), F.col("id") % 3).alias("brand_name"),
        (F.col("id") % 2).cast("int").alias("shipping"), F.repeat(F.lit("x"), (F.col("id") % 9).cast("int")).alias("name"),
        F.repeat(F.lit("y"), (F.col("id") % 4).cast("int")).alias("item_description"), F.log1p("id").alias("log_price"),
    )
    narrow = encode.narrowed(rows, "listing_id", "log_price")
    assert not {"name", "item_description"} & set(narrow.columns)
    train = F.col("listing_id") % 10 != 0
    a = encode.fit_dense(rows.where(train)).apply(rows).select("listing_id", *encode.DENSE)
    b = encode.fit_dense(narrow.where(train)).apply(narrow).select("listing_id", *encode.DENSE)
    a, b = ({r[0]: r[1:] for r in x.collect()} for x in (a, b))
    assert len(a) == 200 and a.keys() == b.keys()
    assert all(b[k] == pytest.approx(a[k], rel=1e-12) for k in a)


def test_target_encode_makes_the_listings_once(spark, monkeypatch):
    from tagwright.plans import catalog, inputs

    made, filled = [], inputs.filled
    monkeypatch.setattr(inputs, "filled", lambda *args: made.append(1) or filled(*args))
    catalog.QUERIES["target_encode"](spark, "/root/testdata/sf0.001")
    assert len(made) == 1

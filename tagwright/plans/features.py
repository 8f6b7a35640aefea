"""Registered queries: vocabularies, sequences, sentence vectors and sparse feature blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.functions import text as tx
from tagwright.operators import clean, porter, sparse
from tagwright.operators import vocab as vo
from tagwright.plans import inputs
from tagwright.plans.cleaning import WORD_VECTORS
from tagwright.plans.oracles import (
    SHORT_STOP,
    bucket,
    grams,
    normalized,
    over,
    tokenized,
    words_of_two,
)
from tagwright.plans.registry import query
from tagwright.plans.stem_oracle import stem_steps
from tagwright.sources import fixtures
from tagwright.sources.listings import is_test, is_train
from tagwright.sources.shared import publish

# ---- vocabularies and sequences ---------------------------------------------------------------


def name_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.filled(spark, d)
    return rows.select("listing_id", "split", tx.tokenize_words(F.col("name")).alias("tokens"))


def doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = fixtures.documents(spark, d)
    return docs.select("listing_id", tx.tokenize_words(F.col("item_description")).alias("tokens"))


def path_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.filled(spark, d)
    return rows.select("listing_id", "split", tx.category_paths(F.col("category_name")).alias("tokens"))


NAME_TOKENS = f"SELECT listing_id, split, {tokenized('name')} AS tokens FROM filled"
DOC_TOKENS = f"SELECT listing_id, {tokenized('item_description')} AS tokens FROM docs"
PATH_TOKENS = """SELECT listing_id, split, list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], '/')) AS tokens
    FROM (SELECT listing_id, split, string_split(regexp_replace(lower(category_name), '[\\s\\p{Z}]+', '', 'g'), '/') AS p FROM filled)"""


def vocab_sql(min_df: int, where: str = "TRUE") -> str:
    return f"""SELECT token, count(*) AS df, row_number() OVER (ORDER BY token) AS idx FROM (
        SELECT listing_id, unnest(list_distinct(tokens)) AS token FROM toks WHERE {where})
        GROUP BY token HAVING count(*) >= {min_df}"""


PLACED = "SELECT listing_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM toks"
ENCODED = """SELECT t.listing_id, coalesce(list(v.idx ORDER BY p.pos) FILTER (WHERE v.idx IS NOT NULL), []) AS indices
    FROM toks t LEFT JOIN placed p USING (listing_id) LEFT JOIN vocab v USING (token) GROUP BY 1"""


@query(over("filled", "SELECT token, df, idx FROM vocab", toks=NAME_TOKENS, vocab=vocab_sql(10, "split = 'train'")))
def vocab_fit(spark: SparkSession, d: str) -> DataFrame:
    return vo.vocab_fit(name_tokens(spark, d).where(is_train()), 10)


@query(
    over(
        "filled",
        "SELECT listing_id, array_to_string(indices, ' ') AS indices FROM encoded",
        toks=PATH_TOKENS,
        placed=PLACED,
        vocab=vocab_sql(55, "split = 'train'"),
        encoded=ENCODED,
    )
)
def sequence_encode(spark: SparkSession, d: str) -> DataFrame:
    rows = path_tokens(spark, d)
    vocab = publish(vo.vocab_fit(rows.where(is_train()), 55), "vocab")
    encoded = vo.sequence_encode(rows, vocab)
    return encoded.select("listing_id", F.array_join("indices", " ").alias("indices"))


@query(
    over(
        "docs",
        "SELECT listing_id, pos, token, idx FROM placed JOIN vocab USING (token)",
        toks=DOC_TOKENS,
        placed=PLACED,
        vocab=vocab_sql(50),
    )
)
def drop_oov(spark: SparkSession, d: str) -> DataFrame:
    rows = doc_tokens(spark, d)
    hits = vo.drop_oov(rows, publish(vo.vocab_fit(rows, 50), "vocab"))
    return hits.select("listing_id", F.col("pos").cast("long"), "token", "idx")


@query(
    over(
        "docs",
        "SELECT CAST(max(len(indices)) AS BIGINT) AS max_len FROM encoded",
        toks=DOC_TOKENS,
        placed=PLACED,
        vocab=vocab_sql(50),
        encoded=ENCODED,
    )
)
def vocab_max_len(spark: SparkSession, d: str) -> DataFrame:
    rows = doc_tokens(spark, d)
    encoded = vo.sequence_encode(rows, publish(vo.vocab_fit(rows, 50), "vocab"))
    return vo.vocab_max_len(encoded).select(F.col("max_len").cast("long"))


@query(
    over(
        "docs",
        """SELECT listing_id, array_to_string(list_transform(range(1, 54), lambda i: coalesce(indices[i], 0)), ' ') AS padded
           FROM encoded""",
        toks=DOC_TOKENS,
        placed=PLACED,
        vocab=vocab_sql(50),
        encoded=ENCODED,
    )
)
def sequence_pad(spark: SparkSession, d: str) -> DataFrame:
    rows = doc_tokens(spark, d)
    encoded = vo.sequence_encode(rows, publish(vo.vocab_fit(rows, 50), "vocab"))
    padded = vo.sequence_pad(F.col("indices"), 53)
    return encoded.select("listing_id", F.array_join(padded, " ").alias("padded"))


@query(
    over(
        "docs",
        """SELECT listing_id, dim, round(CASE WHEN norm > 0 THEN value / norm ELSE 0 END, 4) + 0.0 AS value
           FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY listing_id)) AS norm FROM summed)""",
        toks=DOC_TOKENS,
        placed=PLACED,
        vectors=WORD_VECTORS,
        parts="""SELECT listing_id, unnest(range(0, 64)) AS dim, unnest(vec) AS value
                 FROM placed JOIN vectors ON word = token""",
        summed="""SELECT t.listing_id, g.dim, coalesce(sum(CAST(p.value AS DOUBLE)), 0) AS value
                  FROM toks t CROSS JOIN (SELECT unnest(range(0, 64)) AS dim) g
                  LEFT JOIN parts p ON p.listing_id = t.listing_id AND p.dim = g.dim GROUP BY 1, 2""",
    )
)
def sentence_embedding(spark: SparkSession, d: str) -> DataFrame:
    vectors = publish(fixtures.word_vectors(spark, d), "word-vectors")
    embedded = vo.sentence_embedding(doc_tokens(spark, d), vectors, 64)
    cells = embedded.select("listing_id", F.posexplode("vec").alias("dim", "value"))
    return cells.select("listing_id", F.col("dim").cast("long"), (F.round("value", 4) + 0.0).alias("value"))


@query(
    over(
        "docs",
        """SELECT t.listing_id, coalesce(s.stems, '') AS stems FROM toks t LEFT JOIN (
             SELECT listing_id, string_agg(stem, ' ' ORDER BY pos) AS stems
             FROM (SELECT listing_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM toks)
             JOIN stems USING (token) GROUP BY 1) s USING (listing_id)""",
        toks=DOC_TOKENS,
        **stem_steps("SELECT unnest(tokens) AS token FROM toks"),
    )
)
def stem_tokens(spark: SparkSession, d: str) -> DataFrame:
    stemmed = porter.stem_tokens(doc_tokens(spark, d))
    return stemmed.select("listing_id", F.array_join("tokens", " ").alias("stems"))


# ---- blocks -----------------------------------------------------------------------------------


def features_sql(cells: str, combine: str = "sum", l2: bool = True, block: str = "name") -> str:
    """Long features from ``cells(listing_id, feature, value)``."""
    value = "value / sqrt(sum(value * value) OVER (PARTITION BY listing_id))" if l2 else "value"
    return f"""SELECT listing_id, '{block}' AS block, feature, {value} AS value FROM (
        SELECT listing_id, feature, {combine}(value) AS value FROM ({cells}) GROUP BY 1, 2)"""


def gram_cells(source: str, n: int, size: int, weights: list[float], distinct: bool = False) -> str:
    parts = []
    for i in range(1, n + 1):
        g = grams("t", i)
        g = f"list_distinct({g})" if distinct else g
        parts.append(
            f"SELECT listing_id, {bucket('g', size)} AS feature, {weights[i - 1]}::DOUBLE AS value "
            f"FROM (SELECT listing_id, unnest({g}) AS g FROM {source})"
        )
    return " UNION ALL ".join(parts)


def out_features(df: DataFrame) -> DataFrame:
    return df.select("listing_id", "block", "feature", tx.rounded(F.col("value"), 6).alias("value"))


OUT = "SELECT listing_id, block, feature, round(value, 6) AS value FROM features"


@query(
    over(
        "docs",
        "SELECT n, gram, count(*) AS times FROM grams GROUP BY 1, 2",
        toks=DOC_TOKENS.replace("AS tokens", "AS t"),
        grams=" UNION ALL ".join(f"SELECT {n} AS n, unnest({grams('t', n)}) AS gram FROM toks" for n in (1, 2, 3)),
    )
)
def ngrams(spark: SparkSession, d: str) -> DataFrame:
    rows = doc_tokens(spark, d)

    def numbered(n: int) -> Column:
        grams = tx.ngrams(F.col("tokens"), n)
        return F.transform(grams, lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    cells = rows.select(F.explode(F.concat(*map(numbered, (1, 2, 3)))).alias("c")).select("c.*")
    return cells.groupBy("n", "gram").agg(F.count(F.lit(1)).alias("times"))


NAME_WORDS = f"SELECT listing_id, split, {normalized('name')} AS t FROM filled"
NAME_BAG = features_sql(gram_cells("words", 2, 1 << 29, [1.5, 1.0], distinct=True), "max", l2=False)


@query(over("filled", OUT, words=NAME_WORDS, features=NAME_BAG))
def wordbag_name(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.filled(spark, d).select("listing_id", "name")
    return out_features(sparse.stack_blocks(rows, [sparse.wordbag_name(F.col("name"))]))


@query(
    over(
        "docs",
        OUT,
        words=f"SELECT listing_id, {normalized('item_description')} AS t FROM docs",
        features=features_sql(gram_cells("words", 2, 1 << 28, [1.0, 1.0]), block="desc"),
    )
)
def wordbag_desc(spark: SparkSession, d: str) -> DataFrame:
    docs = fixtures.documents(spark, d)
    return out_features(sparse.stack_blocks(docs, [sparse.wordbag_desc(F.col("item_description"))]))


HASH_WORDS = (
    f"SELECT listing_id, list_filter({words_of_two('lower(item_description)')}, "
    f"lambda w: NOT list_contains({SHORT_STOP}, w)) AS t FROM docs"
)
HASH_DESC = features_sql(gram_cells("words", 3, 1 << 27, [1.0] * 3), block="desc")


def hashed_docs(spark: SparkSession, d: str, by_row: bool = False) -> DataFrame:
    docs = fixtures.documents(spark, d).withColumn("item_description", F.lower("item_description"))
    return sparse.stack_blocks(docs, [sparse.hash_vectorize("desc", F.col("item_description"), 3)], by_row=by_row)


@query(over("docs", OUT, words=HASH_WORDS, features=HASH_DESC))
def hash_vectorize(spark: SparkSession, d: str) -> DataFrame:
    return out_features(hashed_docs(spark, d))


HASH_SIGN = "CASE WHEN CAST(concat('0x', substr(md5(g), 9, 2)) AS INT) % 2 = 1 THEN -1.0 ELSE 1.0 END"
SIGNED_DESC = features_sql(
    " UNION ALL ".join(
        f"SELECT listing_id, {bucket('g', 1 << 27)} AS feature, CAST({HASH_SIGN} AS DOUBLE) AS value "
        f"FROM (SELECT listing_id, unnest({grams('t', n)}) AS g FROM words)"
        for n in (1, 2, 3)
    ),
    block="desc",
)


@query(over("docs", OUT + " WHERE value <> 0", words=HASH_WORDS, features=SIGNED_DESC))
def hash_vectorize_signed(spark: SparkSession, d: str) -> DataFrame:
    """With the sign of a second hash, so that features that share a bucket tend to cancel out."""
    docs = fixtures.documents(spark, d).withColumn("item_description", F.lower("item_description"))
    block = sparse.hash_vectorize("desc", F.col("item_description"), 3, signed=True)
    return out_features(sparse.stack_blocks(docs, [block]))


@query(
    over(
        "cats4",
        OUT,
        features=features_sql(
            f"SELECT listing_id, {bucket('g', 1 << 27)} AS feature, 1.0::DOUBLE AS value FROM "
            "(SELECT listing_id, unnest([general_cat, subcat_1, subcat_2, gen_subcat1]) AS g FROM cats4)",
            block="category",
        ),
    )
)
def category_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.unified(spark, d).select("listing_id", "category_name")
    return out_features(sparse.stack_blocks(rows, [sparse.category_tokens(F.col("category_name"))]))


CATEGORY_WORDS = " UNION ALL ".join(
    f"""SELECT listing_id, '{c}' AS block, feature, CAST(count(*) AS DOUBLE) AS value FROM (
        SELECT listing_id, unnest({words_of_two(f'lower({c})')}) AS feature FROM tagged) GROUP BY 1, 3"""
    for c in clean.LEVELS
)


@query(over("tagged", OUT, features=CATEGORY_WORDS))
def count_category_words(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.tagged(spark, d).select("listing_id", *clean.LEVELS)
    blocks = [sparse.count_category_words(c, F.col(c)) for c in clean.LEVELS]
    return out_features(sparse.stack_blocks(rows, blocks))


CROSSED = """SELECT listing_id, brand_name, concat(general_cat, '_', item_condition_id) AS gencat_cond,
    concat(subcat_1, '_', item_condition_id) AS subcat_1_cond, concat(subcat_2, '_', item_condition_id) AS subcat_2_cond
    FROM cats4"""
WHOLE = ["brand_name", "gencat_cond", "subcat_1_cond", "subcat_2_cond"]


def whole_values(spark: SparkSession, d: str) -> DataFrame:
    rows = clean.cross_keys(inputs.cats4(spark, d)).select("listing_id", *WHOLE)
    return sparse.stack_blocks(rows, [sparse.count_whole_value(c, F.col(c)) for c in WHOLE])


@query(
    over(
        "cats4",
        OUT,
        crossed=CROSSED,
        features=" UNION ALL ".join(
            f"""SELECT listing_id, '{c}' AS block, {c} AS feature, 1.0::DOUBLE AS value FROM crossed
                WHERE {c} IN (SELECT {c} FROM crossed WHERE {c} <> '' GROUP BY 1 HAVING count(*) >= 2)"""
            for c in WHOLE
        ),
    )
)
def count_whole_value(spark: SparkSession, d: str) -> DataFrame:
    features = publish(whole_values(spark, d), "features")
    kept = publish(sparse.kept_features(sparse.col_nnz(features), 2), "kept")
    return out_features(sparse.df_filter(features, kept))


@query(
    over(
        "tagged",
        """SELECT listing_id, 'brand' AS block, brand_name AS feature, 1.0::DOUBLE AS value FROM tagged
           WHERE brand_name IN (SELECT brand_name FROM tagged WHERE split = 'train' AND shipping = 1
                                GROUP BY 1 HAVING count(*) >= 600)""",
    )
)
def onehot_brand(spark: SparkSession, d: str) -> DataFrame:
    """Fitted on the brands often shipped, so that some brands are unseen and give nothing."""
    rows = inputs.tagged(spark, d).select("listing_id", "split", "brand_name", "shipping")
    block = [sparse.onehot("brand", F.col("brand_name"))]
    shipped = rows.where(is_train() & (F.col("shipping") == 1))
    fitted = sparse.kept_features(sparse.col_nnz(sparse.stack_blocks(shipped, block)), 600)
    return out_features(sparse.df_filter(sparse.stack_blocks(rows, block), publish(fitted, "brands")))


@query(
    over(
        "filled",
        """SELECT listing_id, 'cond' AS block, CAST(item_condition_id AS VARCHAR) AS feature, 1.0::DOUBLE AS value FROM filled
           UNION ALL SELECT listing_id, 'shipping', 'shipping', CAST(shipping AS DOUBLE) FROM filled WHERE shipping <> 0""",
    )
)
def dummies(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.filled(spark, d).select("listing_id", "item_condition_id", "shipping")
    return out_features(
        sparse.stack_blocks(rows, sparse.dummies(F.col("item_condition_id"), F.col("shipping")))
    )


@query(
    over(
        "tagged",
        """SELECT listing_id, 'brand_name' AS block, CASE WHEN brand_name IN (
             SELECT brand_name FROM tagged WHERE split = 'train' AND shipping = 1 GROUP BY 1 HAVING count(*) >= 600)
             THEN brand_name ELSE '<NOT_SHOWN>' END AS feature, 1.0::DOUBLE AS value FROM tagged""",
    )
)
def onehot_not_shown(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.tagged(spark, d)
    shipped = rows.where(is_train() & (F.col("shipping") == 1))
    fitted = shipped.groupBy("brand_name").agg(F.count(F.lit(1)).alias("n")).where("n >= 600")
    return out_features(sparse.onehot_not_shown(rows, "brand_name", publish(fitted, "shown")))


@query(
    over(
        "lowered",
        " UNION ALL ".join(
            f"SELECT listing_id, '{b}' AS block, CAST({c} AS VARCHAR) AS feature, 1.0::DOUBLE AS value FROM lowered"
            for b, c in {
                "has_brand": "CAST(has_brand AS INT)",
                "shipping": "shipping",
                "cond": "item_condition_id",
            }.items()
        ),
    )
)
def onehot_codes(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.lowered(spark, d).select("listing_id", "has_brand", "shipping", "item_condition_id")
    blocks = sparse.onehot_codes(F.col("has_brand"), F.col("shipping"), F.col("item_condition_id"))
    return out_features(sparse.stack_blocks(rows, blocks))


# ---- on the long table ------------------------------------------------------------------------


@query(over("docs", "SELECT block, feature, count(*) AS df FROM features GROUP BY 1, 2", words=HASH_WORDS, features=HASH_DESC))
def col_nnz(spark: SparkSession, d: str) -> DataFrame:
    return sparse.col_nnz(hashed_docs(spark, d))


KEPT_DOCS = """SELECT feature FROM features GROUP BY 1
    HAVING count(*) >= 2 AND count(*) <= 0.5 * (SELECT count(*) FROM docs)"""


@query(
    over(
        "docs",
        OUT + " WHERE feature IN (SELECT feature FROM kept)",
        words=HASH_WORDS,
        features=HASH_DESC,
        kept=KEPT_DOCS,
    )
)
def df_filter(spark: SparkSession, d: str) -> DataFrame:
    features = publish(hashed_docs(spark, d, by_row=True), "features")
    nnz = sparse.col_nnz(features)
    kept = sparse.kept_features(nnz, 2, 0.5, fixtures.documents(spark, d))
    return out_features(sparse.df_filter(features, publish(kept, "kept")))


STACKED = f"""SELECT * FROM bag
    UNION ALL SELECT listing_id, 'lang', lang, 1.0::DOUBLE FROM docs
    UNION ALL SELECT listing_id, 'source', source, 1.0::DOUBLE FROM docs"""


def document_blocks(spark: SparkSession, d: str, by_row: bool = False) -> DataFrame:
    table = fixtures.stored_documents(spark, d, "doc_id", "text", "lang", "source")
    docs = table.select(
        F.col("doc_id").cast("string").alias("listing_id"), F.lower("text").alias("text"), "lang", "source"
    )
    return sparse.stack_blocks(
        docs,
        [
            sparse.hash_vectorize("desc", F.col("text"), 3),
            sparse.onehot("lang", F.col("lang")),
            sparse.onehot("source", F.col("source")),
        ],
        by_row=by_row,
    )


@query(over("docs", OUT, words=HASH_WORDS, bag=HASH_DESC, features=STACKED))
def stack_blocks(spark: SparkSession, d: str) -> DataFrame:
    return out_features(document_blocks(spark, d))


@query(
    over(
        "filled",
        "SELECT listing_id, block, feature, round(value / sqrt(sum(value * value) OVER (PARTITION BY listing_id)), 6) AS value FROM features",
        words=NAME_WORDS,
        features=NAME_BAG,
    )
)
def l2_norm(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.filled(spark, d).select("listing_id", "name")
    return out_features(sparse.l2_norm(sparse.stack_blocks(rows, [sparse.wordbag_name(F.col("name"))])))


@query(
    over(
        "docs",
        """SELECT listing_id, block, feature, round(value / sqrt(sum(value * value) OVER (PARTITION BY listing_id)), 6) AS value
           FROM (SELECT f.listing_id, f.block, f.feature,
                   f.value * (ln((1 + (SELECT count(*) FROM docs)) / (1.0::DOUBLE + n.df)) + 1) AS value
                 FROM features f JOIN nnz n USING (block, feature))""",
        words=HASH_WORDS,
        bag=HASH_DESC,
        features=STACKED,
        nnz="SELECT block, feature, count(*) AS df FROM features GROUP BY 1, 2",
    )
)
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    features = publish(document_blocks(spark, d, by_row=True), "features")
    nnz = publish(sparse.col_nnz(features), "nnz")
    return out_features(sparse.tfidf(features, nnz, fixtures.documents(spark, d)))


@query(
    over(
        "filled",
        """SELECT a.block, a.feature, a.df, b.df AS df_right FROM
           (SELECT block, feature, count(*) AS df FROM features JOIN filled USING (listing_id) WHERE split = 'train' GROUP BY 1, 2) a
           JOIN (SELECT block, feature, count(*) AS df FROM features JOIN filled USING (listing_id) WHERE split = 'test' GROUP BY 1, 2) b
           USING (block, feature)""",
        words=NAME_WORDS,
        features=NAME_BAG,
    )
)
def feature_intersect(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.filled(spark, d).select("listing_id", "name", "split")
    features = sparse.stack_blocks(rows, [sparse.wordbag_name(F.col("name"))], carry=["split"])
    return sparse.split_counts(features)


@query(
    over(
        "docs",
        """SELECT block, feature, count(*) AS df, row_number() OVER (ORDER BY block, feature) - 1 AS index
           FROM features GROUP BY 1, 2 HAVING count(*) >= 2""",
        words=HASH_WORDS,
        bag=HASH_DESC,
        features=STACKED,
    )
)
def feature_index(spark: SparkSession, d: str) -> DataFrame:
    kept = sparse.kept_features(sparse.col_nnz(document_blocks(spark, d)), 2)
    return sparse.feature_index(kept)


@query(
    over(
        "docs",
        """SELECT d.listing_id, i.index AS place, round(f.value, 6) AS value FROM docs d
           LEFT JOIN (features f JOIN index i USING (block, feature)) ON f.listing_id = d.listing_id""",
        words=HASH_WORDS,
        bag=HASH_DESC,
        features=STACKED,
        index="""SELECT block, feature, CAST(row_number() OVER (ORDER BY block, feature) - 1 AS INT) AS index
                 FROM features GROUP BY 1, 2 HAVING count(*) >= 2""",
    )
)
def to_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors, unpacked to one row per cell (one row of nulls for an empty vector)."""
    features = publish(document_blocks(spark, d, by_row=True), "features")
    index = publish(sparse.feature_index(sparse.kept_features(sparse.col_nnz(features), 2)), "index")
    vectors = sparse.to_vectors(features, index, features)
    return sparse.unpacked(vectors).select("listing_id", "place", tx.rounded(F.col("value"), 6).alias("value"))

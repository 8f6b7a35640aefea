"""Sparse feature blocks as one long table ``(listing_id, block, feature, value)``.

A block is an array expression over a listing row. Equal features are combined and rows of a block
are brought to length one inside the row; the cells of all blocks are exploded last. So ten blocks
cost one pass over the data and no shuffle. Runs of words are hashed by Arrow batches (``grams``): an
expression would be interpreted gram by gram.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwright.functions import text as tx
from tagwright.functions.words import SHORT_STOP_WORDS
from tagwright.operators import grams, packed
from tagwright.operators.lookup import dense_index, fits, lookup_join
from tagwright.sources.shared import fresh_path, publish

NOT_SHOWN = "<NOT_SHOWN>"
KEY = ["block", "feature"]
# Hashed features whose places go to every worker process, at 20 bytes each.
PLACES = 5_000_000


@dataclass(frozen=True)
class Block:
    """``emit`` yields ``array<struct<feature, value>>``; equal features of a row are combined by
    ``sum`` or ``max``; ``l2`` gives the row's part of this block length one; ``min_df`` is the
    number of rows a feature must occur in to be kept by ``df_filter``. With ``hashing``, ``emit``
    yields the row's words instead, none of which holds a space. ``lone``: it yields one cell at most."""

    name: str
    emit: Column
    combine: str = "sum"
    l2: bool = False
    min_df: int = 1
    hashing: grams.Hashing | None = None
    lone: bool = False


def weighted(features: Column, weight: float = 1.0) -> Column:
    return F.transform(
        features, lambda g: F.struct(g.alias("feature"), F.lit(float(weight)).alias("value"))
    )


def hashed(features: Column, buckets: int, signed: bool = False) -> Column:
    def place(f: Column) -> Column:
        value = f["value"] * tx.hash_sign(f["feature"]) if signed else f["value"]
        return F.struct(
            tx.bucket(f["feature"], buckets).cast("string").alias("feature"), value.alias("value")
        )

    return F.transform(features, place)


def single(feature: Column, value: Column | float = 1.0) -> Column:
    """One feature, or none when it is null or empty."""
    cell = F.struct(feature.cast("string").alias("feature"), F.lit(value).cast("double").alias("value"))
    absent = feature.isNull() | (feature.cast("string") == "")
    return F.filter(F.array(F.when(~absent, cell)), lambda x: x.isNotNull())


# ---- the blocks -------------------------------------------------------------------------------

def _hashed_words(name: str, words: Column, min_df: int, how: grams.Hashing) -> Block:
    return Block(name, words, how.combine, how.l2, min_df, how)


def wordbag_name(text: Column, buckets: int = 1 << 29, weights: tuple[float, float] = (1.5, 1.0)) -> Block:
    return _hashed_words("name", tx.normalized_words(text), 2, grams.Hashing(tuple(weights), buckets, combine="max"))


def wordbag_desc(text: Column, buckets: int = 1 << 28, weights: tuple[float, float] = (1.0, 1.0)) -> Block:
    return _hashed_words("desc", tx.normalized_words(text), 2, grams.Hashing(tuple(weights), buckets, l2=True))


def hash_vectorize(
    name: str, text: Column, n: int, buckets: int = 1 << 27, signed: bool = False, min_df: int = 2
) -> Block:
    words = F.filter(tx.words_of_two(text, lowercase=False), lambda w: ~w.isin(SHORT_STOP_WORDS))
    return _hashed_words(name, words, min_df, grams.Hashing((1.0,) * n, buckets, signed, l2=True))


def category_tokens(path: Column, buckets: int = 1 << 27) -> Block:
    tokens = F.array(*tx.split_category4(path))
    return Block("category", hashed(weighted(tokens), buckets), l2=True, min_df=2)


def count_category_words(name: str, level: Column) -> Block:
    return Block(name, weighted(tx.words_of_two(level)))


def count_whole_value(name: str, value: Column, min_df: int = 2) -> Block:
    return Block(name, single(value), min_df=min_df, lone=True)


def onehot(name: str, value: Column) -> Block:
    return Block(name, single(value), lone=True)


def numeric(name: str, value: Column) -> Block:
    return Block(name, single(F.lit(name), value), lone=True)


def dummies(condition: Column, shipping: Column) -> list[Block]:
    """The condition as one column per value, shipping as one numeric column."""
    return [onehot("cond", condition), numeric("shipping", shipping)]


def onehot_codes(has_brand: Column, shipping: Column, condition: Column) -> list[Block]:
    return [
        onehot("has_brand", has_brand.cast("int")),
        onehot("shipping", shipping),
        onehot("cond", condition),
    ]


# ---- the long table ---------------------------------------------------------------------------

def _combined(block: Block) -> Column:
    """The block's cells of one row: sorted by feature, each run of equal features as one cell.

    The work grows with the row's cells (and their sort): a run is read by its places, as a slice
    would copy all cells of the row for every feature.
    """

    def cells(at: Column) -> Column:
        start = lambda i: (i == 0) | (F.get(at, i)["feature"] != F.get(at, i - 1)["feature"])

        def runs(starts: Column) -> Column:
            def run(p: Column, j: Column) -> Column:
                last = F.coalesce(F.get(starts, j + 1), F.size(at)) - 1
                if block.combine == "max":
                    value = F.get(at, last)["value"]  # equal features are sorted by value
                else:
                    added = F.aggregate(F.sequence(p, last), F.lit(0.0), lambda a, i: a + F.get(at, i)["value"])
                    value = F.when(p == last, F.get(at, p)["value"]).otherwise(added)
                return F.struct(F.get(at, p)["feature"].alias("feature"), value.alias("value"))

            return F.filter(F.transform(starts, run), lambda c: c["value"] != 0)

        return tx.bound(F.filter(F.sequence(F.lit(0), F.size(at) - 1), start), runs)

    none = F.array().cast("array<struct<feature:string,value:double>>")
    if block.lone:  # nothing to sort or to combine
        found = F.filter(block.emit, lambda c: c["value"] != 0)
    else:
        found = tx.bound(F.sort_array(block.emit), lambda at: F.when(F.size(at) > 0, cells(at)).otherwise(none))
    named = lambda c, length: F.struct(
        F.lit(block.name).alias("block"), c["feature"].alias("feature"), (c["value"] / length).alias("value")
    )
    if not block.l2:
        return F.transform(found, lambda c: named(c, F.lit(1.0)))
    square = lambda a, c: a + c["value"] * c["value"]
    return tx.bound(
        found,
        lambda own: tx.bound(
            F.sqrt(F.aggregate(own, F.lit(0.0), square)), lambda length: F.transform(own, lambda c: named(c, length))
        ),
    )


def stack_blocks(df: DataFrame, blocks: Sequence[Block], carry: Sequence[str] = (), by_row: bool = False) -> DataFrame:
    """All blocks of every listing (``listing_id`` unique), with the columns ``carry`` of its row.
    Nothing is shuffled: a listing's features come from its own row. ``by_row`` leaves them there (``stack_rows``)."""
    if by_row:
        return stack_rows(df, blocks, carry)
    own = ["listing_id", *carry]
    plain, words = [b for b in blocks if not b.hashing], [b for b in blocks if b.hashing]
    combined = F.concat(*[_combined(b) for b in plain]) if plain else None
    if not words:
        return df.select(*own, F.explode(combined).alias("_c")).select(*own, "_c.*")
    inputs = [F.array_join(b.emit, " ").alias(f"_words{i}") for i, b in enumerate(words)]
    inputs += [combined.alias("_cells")] if plain else []
    rows = df.select(*own, *inputs)
    out = T.StructType([*rows.schema.fields[: len(own)], *T._parse_datatype_string("block string, feature string, value double")])
    names, plans, others, width = out.fieldNames(), [(b.name, b.hashing) for b in words], bool(plain), len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = grams.Prints()
        for batch in batches:
            kept = batch.columns[:width]
            for i, (block, how) in enumerate(plans):
                texts = batch.column(width + i).to_pylist()
                for first, end in grams.runs_of_rows(texts):
                    row, bucket, value = grams.cells(texts[first:end], how, known)
                    found = [pa.repeat(block, len(row)), pa.array(bucket).cast(pa.string()), pa.array(value)]
                    yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row + first)) for c in kept], *found], names)
            if others:
                cells, row = batch.columns[-1].flatten(), pc.list_parent_indices(batch.columns[-1])
                yield pa.RecordBatch.from_arrays([*[c.take(row) for c in kept], *cells.flatten()], names)

    return rows.mapInArrow(run, out)


def _length(by: Sequence[str]) -> Column:
    return F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(*by)))


def l2_norm(features: DataFrame, by: Sequence[str] = ("listing_id",)) -> DataFrame:
    """Each row's values divided by their Euclidean length; the group is one listing's own features."""
    return features.withColumn("value", F.col("value") / _length(by))


def col_nnz(features: DataFrame) -> DataFrame:
    """Rows in which each feature is not zero: ``(block, feature, df)``; also of ``stack_rows``."""
    if is_stacked(features):
        return count_stacked(features).drop("_train")
    present = features.where(F.col("value") != 0)
    return present.groupBy(*KEY).agg(F.count(F.lit(1)).alias("df"))


def kept_features(
    nnz: DataFrame, min_df: int | dict[str, int] = 2, max_share: float = 1.0, rows: DataFrame | None = None
) -> DataFrame:
    """Features with ``min_df <= df <= max_share * rows``. ``min_df`` may differ per block."""
    if isinstance(min_df, dict):
        least = F.lit(1)
        for block, n in min_df.items():
            least = F.when(F.col("block") == block, n).otherwise(least)
    else:
        least = F.lit(min_df)
    kept = nnz.where(F.col("df") >= least)
    if max_share < 1.0:
        total = rows.agg(F.count(F.lit(1))).scalar()
        kept = kept.where(F.col("df") <= total * max_share)
    return kept


def df_filter(features: DataFrame, kept: DataFrame) -> DataFrame:
    """Only features of the fitted set. If that is too big to broadcast, rows of the heaviest features
    still stay where they are. Hashed cells of ``stack_rows`` are not moved at all: the counts of all
    buckets go to every worker."""
    if is_stacked(features):
        counts = _counts_of(kept, features)
        if counts is None:
            return df_filter(unstacked(features), kept)
        shared = features.sparkSession.sparkContext.broadcast(counts)
        hashed = _hashed(features, keep=lambda name, bucket: shared.value[name].of(bucket) > 0)
        return hashed.unionByName(df_filter(_plain(features), kept.where(~F.col("block").isin(list(counts)))))
    return lookup_join(features, kept, KEY, "left_semi", weight="df")


def onehot_not_shown(df: DataFrame, column: str, fitted: DataFrame) -> DataFrame:
    """One-hot by fitted values ``(column, n)``; values never seen share one reserved feature."""
    seen = fitted.select(column, F.col("n").alias("_n"))
    joined = lookup_join(df, seen, column, "left", weight="_n")
    feature = F.when(F.col("_n").isNotNull(), F.col(column).cast("string")).otherwise(NOT_SHOWN)
    return joined.select(
        "listing_id", F.lit(column).alias("block"), feature.alias("feature"), F.lit(1.0).alias("value")
    )


def feature_intersect(left: DataFrame, right: DataFrame, min_df: int = 1) -> DataFrame:
    """Features frequent enough on both sides, from two ``col_nnz`` tables (keys unique, so no skew)."""
    a = left.where(F.col("df") >= min_df)
    b = right.where(F.col("df") >= min_df).select(*KEY, F.col("df").alias("df_right"))
    return a.join(b, KEY)


def split_counts(features: DataFrame, min_df: int = 1) -> DataFrame:
    """``feature_intersect`` of the train and test rows of one long table that carries ``split``,
    from a single pass: ``(block, feature, df, df_right)``."""
    counts = features.where(F.col("value") != 0).groupBy(*KEY).agg(
        F.count_if(F.col("split") == "train").alias("df"), F.count_if(F.col("split") == "test").alias("df_right")
    )
    return counts.where((F.col("df") >= min_df) & (F.col("df_right") >= min_df))


def fit_features(features: DataFrame, min_df: int | dict[str, int], both_splits: bool = False) -> DataFrame:
    """``(block, feature, df, index)`` of the features kept, from one aggregation of the long table.

    ``features`` carries ``split``. With ``both_splits`` only features that occur in train and in
    test rows get an index; the others are kept with a null one, as they count for weights and
    lengths.
    """
    counts = features.where(F.col("value") != 0).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("df"), F.count_if(F.col("split") == "train").alias("_train")
    )
    return _fit_counts(counts, min_df, both_splits)


def _fit_counts(counts: DataFrame, min_df: int | dict[str, int], both_splits: bool) -> DataFrame:
    kept = publish(kept_features(counts, min_df), "kept")
    shared = kept.where((F.col("_train") > 0) & (F.col("_train") < F.col("df")))
    if not both_splits:
        return publish(feature_index(kept), "features-fitted")
    return publish(kept.drop("_train").join(feature_index(shared).drop("df"), KEY, "left"), "features-fitted")


def indexed(features: DataFrame, fitted: DataFrame, rows: int | Column | None = None) -> DataFrame:
    """``(listing_id, index, value)`` of any rows' features by a fitted table, from one join.

    ``rows`` (how many the table was fitted on) asks for TF-IDF weights and rows of length one over
    all kept features. Features that were not kept, or have no index, give nothing.
    """
    found = lookup_join(features, fitted, KEY, "inner", weight="df")
    if rows is not None:
        n = F.lit(rows) if isinstance(rows, int) else rows
        weight = F.col("value") * (F.log((n + 1) / (F.col("df") + 1)) + 1)
        found = l2_norm(found.withColumn("value", weight))
    return found.where(F.col("index").isNotNull()).select("listing_id", "index", "value")


def tfidf(features: DataFrame, nnz: DataFrame, rows: DataFrame) -> DataFrame:
    """``value * (ln((1 + n) / (1 + df)) + 1)`` over all blocks, then each listing to length one. Of
    ``stack_rows`` no cell is moved, unless the counts are too big to go to every worker or listings repeat."""
    if is_stacked(features):
        long = lambda part: tfidf(unstacked(part), nnz, rows)
        counts, others = _counts_of(nnz, features), nnz.where(~F.col("block").isin(packed.names(features.columns)))
        if counts is None or not fits(others):
            return long(features)
        texts = {(r["block"], r["feature"]): r["df"] for r in others.select(*KEY, "df").collect()}
        return _alone(features, lambda part: _weighted(part, counts, texts, rows.count()), long)
    n = rows.agg(F.count(F.lit(1))).scalar()
    joined = lookup_join(features, nnz, KEY, "inner", weight="df")
    idf = F.log((n + 1) / (F.col("df") + 1)) + 1
    return l2_norm(joined.select("listing_id", *KEY, (F.col("value") * idf).alias("value")))


def _weighted(stacked: DataFrame, counts: dict[str, packed.Counts], texts: dict[tuple, int], n: int) -> DataFrame:
    """``tfidf`` of a listing inside its row."""
    rows = stacked.select("listing_id", *_of(_held(stacked)))
    shared = rows.sparkSession.sparkContext.broadcast((counts, texts))
    out = T.StructType([rows.schema["listing_id"], *T._parse_datatype_string(LONG)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = shared.value
        for batch in (piece for batch in batches for piece in packed.pieces(batch)):
            found, length = [], np.zeros(batch.num_rows)
            for name, known in counts.items():
                row, bucket, value = packed.cells(batch, name)
                found.append((row, known.of(bucket), value, pa.repeat(name, len(row)), bucket))
            row, block, feature, value = _plain_cells(batch.column("plain"))
            df = np.array([texts.get(k, 0) for k in zip(block.to_pylist(), feature.to_pylist())], np.int64)
            found.append((row, df, value, block, feature))
            for i, (row, df, value, block, feature) in enumerate(found):
                hit = np.flatnonzero(df)
                row, value = row[hit], value[hit] * (np.log((n + 1) / (df[hit] + 1)) + 1)
                length += np.bincount(row, value * value, minlength=batch.num_rows)
                found[i] = row, value, block.take(pa.array(hit)), pa.array(feature).take(pa.array(hit)).cast(pa.string())
            length = np.sqrt(length)
            for row, value, block, feature in found:
                cells = [batch.column(0).take(pa.array(row)), block, feature, pa.array(value / length[row])]
                yield pa.RecordBatch.from_arrays(cells, out.fieldNames())

    return rows.mapInArrow(run, out)


def _plain_cells(plain: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """Row, block, feature and value of ``plain`` cells."""
    block, feature, value = plain.flatten().flatten()
    return pc.list_parent_indices(plain).to_numpy().astype(np.int64), block, feature, value.to_numpy()


def feature_index(kept: DataFrame) -> DataFrame:
    """``(block, feature, df, index)`` with index 0..D-1."""
    return dense_index(kept.select(*KEY, "df"), KEY, "index", start=0)


def to_vectors(features: DataFrame, index: DataFrame, rows: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One sparse vector per row of ``rows``, empty if no feature is left, with its ``extra`` columns.

    The vectors are written to the shared folder and read back typed as ML vectors: fitting passes
    over them many times, and this way no value goes through Python. Where ``features`` are ``stack_rows`` and
    ``rows`` the same, a listing's vector is made from its own row.
    """
    if is_stacked(features):
        long = lambda part: to_vectors(unstacked(part), index, part, extra)
        if rows is not features:
            return to_vectors(unstacked(features), index, rows, extra)
        return _alone(features, lambda part: stacked_vectors(part, (), index, None, extra), long)
    return pack_vectors(indexed(features, index), index, rows, extra)


def pack_vectors(cells: DataFrame, fitted: DataFrame, rows: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """``to_vectors`` for cells ``(listing_id, index, value)`` whose indices come from ``fitted``."""
    spark = cells.sparkSession
    size = fitted.agg((F.max("index") + 1).cast("int")).scalar()
    cells = cells.select(
        "listing_id", F.struct(F.col("index").cast("int").alias("i"), F.col("value").alias("v")).alias("_cell")
    )
    keep = rows.select("listing_id", *extra)
    stacked = cells.unionByName(keep, allowMissingColumns=True)
    packed = stacked.groupBy("listing_id").agg(
        F.sort_array(F.collect_list("_cell")).alias("_cells"), *[F.max(c).alias(c) for c in extra]
    )
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.coalesce(size, F.lit(0)).alias("size"),
        F.transform("_cells", lambda c: c["i"]).alias("indices"),
        F.transform("_cells", lambda c: c["v"]).alias("values"),
    )
    path = fresh_path(spark, "vectors")
    out = packed.select("listing_id", *extra, vector.alias("features"))
    out.write.parquet(path)
    schema = T.StructType([*[f for f in out.schema if f.name != "features"], T.StructField("features", VectorUDT())])
    return spark.read.schema(schema).parquet(path)


def unpacked(vectors: DataFrame) -> DataFrame:
    """``(listing_id, place, value)`` per cell of stored vectors; an empty vector gives one row of nulls."""
    parts = vectors.select("listing_id", F.unwrap_udt("features").alias("v"))
    cells = F.arrays_zip(F.col("v.indices").alias("place"), F.col("v.values").alias("value"))
    return parts.select("listing_id", F.explode_outer(cells).alias("c")).select("listing_id", "c.place", "c.value")


# ---- the table with one row per listing -------------------------------------------------------


def stack_rows(df: DataFrame, blocks: Sequence[Block], carry: Sequence[str] = ()) -> DataFrame:
    """The cells of ``stack_blocks`` with one row per listing, also one without cells: two columns of bytes per
    hashed block (``packed``), ``plain`` cells of the others. Block names must differ."""
    own = ["listing_id", *carry]
    plain, words = [b for b in blocks if not b.hashing], [b for b in blocks if b.hashing]
    if len({b.name for b in blocks}) < len(blocks):
        raise ValueError("two blocks of one name")
    none = F.array().cast("array<struct<block:string,feature:string,value:double>>")
    inputs = [F.array_join(b.emit, " ").alias(f"_words{i}") for i, b in enumerate(words)]
    rows = df.select(*own, (F.concat(*[_combined(b) for b in plain]) if plain else none).alias("plain"), *inputs)
    pair = [T.StructField(kind + b.name, T.BinaryType()) for b in words for kind in (packed.KEYS, packed.VALUES)]
    out = T.StructType([*rows.schema.fields[: len(own) + 1], *pair])
    names, plans, width = out.fieldNames(), [b.hashing for b in words], len(own) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = grams.Prints()
        for batch in batches:
            texts = [c.to_pylist() for c in batch.columns[width:]]
            together = ["".join(filter(None, of)) for of in zip(*texts)] if texts else [None] * batch.num_rows
            for first, end in grams.runs_of_rows(together):
                cells = []
                for t, how in zip(texts, plans):
                    row, bucket, value = grams.cells(t[first:end], how, known)
                    ends = _ends(row, end - first)
                    cells += [packed.binary(ends, packed.steps(ends, bucket)), packed.binary(ends, value)]
                yield pa.RecordBatch.from_arrays([*[c.slice(first, end - first) for c in batch.columns[:width]], *cells], names)

    return rows.mapInArrow(run, out)


def is_stacked(rows: DataFrame) -> bool:
    """Whether these are rows of ``stack_rows``."""
    return "plain" in rows.columns and "feature" not in rows.columns


def _ends(row: np.ndarray, number: int) -> np.ndarray:
    return np.r_[0, np.cumsum(np.bincount(row, minlength=number))]


def _offsets(row: np.ndarray, number: int) -> pa.Array:
    return pa.array(_ends(row, number).astype(np.int32))


def _held(stacked: DataFrame) -> list[str]:
    """The columns of ``stack_rows`` that hold cells."""
    return ["plain", *[kind + b for b in packed.names(stacked.columns) for kind in (packed.KEYS, packed.VALUES)]]


def _of(columns: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


LONG = "block string, feature string, value double"


def unstacked(stacked: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The long table of ``stack_rows``."""
    own = ["listing_id", *carry]
    plain = _plain(stacked, own)
    return plain.unionByName(_hashed(stacked, own)) if packed.names(stacked.columns) else plain


def _plain(stacked: DataFrame, own: Sequence[str] = ("listing_id",)) -> DataFrame:
    return stacked.select(*own, F.explode("plain").alias("c")).select(*own, "c.*")


def _hashed(
    stacked: DataFrame, own: Sequence[str] = ("listing_id",), keep: Callable[[str, np.ndarray], np.ndarray] | None = None
) -> DataFrame:
    """The long table of the hashed cells, or of those that ``keep`` tells of a block's buckets."""
    names = packed.names(stacked.columns)
    rows = stacked.select(*own, *_of(_held(stacked)[1:]))
    out = T.StructType([*rows.schema.fields[: len(own)], *T._parse_datatype_string(LONG)])
    columns = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for batch in batches for piece in packed.pieces(batch)):
            for name in names:
                row, bucket, value = packed.cells(batch, name)
                if keep is not None:
                    some = keep(name, bucket)
                    row, bucket, value = row[some], bucket[some], value[some]
                found = [pa.repeat(name, len(row)), pa.array(bucket).cast(pa.string()), pa.array(value)]
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in batch.columns[: len(own)]], *found], columns)

    return rows.mapInArrow(run, out)


def _counts_of(table: DataFrame, stacked: DataFrame) -> dict[str, packed.Counts] | None:
    """The counts of a table ``(block, feature, df)`` for the hashed blocks, if every worker can hold them."""
    found = {}
    for name in packed.names(stacked.columns):
        found[name] = packed.fitted_counts(table, name)
        if found[name] is None:
            return None
    return found


def _alone(stacked: DataFrame, fast: Callable[[DataFrame], DataFrame], slow: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fast`` of the rows whose ``listing_id`` is theirs alone, ``slow`` of the others."""
    many = publish(stacked.groupBy(F.col("listing_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "repeated")
    if many.isEmpty():
        return fast(stacked)
    same = F.col("listing_id").eqNullSafe(F.col("_id"))
    return fast(stacked.join(many, same, "left_anti")).unionByName(slow(stacked.join(many, same, "left_semi")))


def count_stacked(stacked: DataFrame) -> DataFrame:
    """``(block, feature, df, _train)``: the rows of ``stack_rows`` that hold each feature, and those of them in
    the split ``train``."""
    train = F.coalesce((F.col("split") == "train").cast("long"), F.lit(0)) if "split" in stacked.columns else F.lit(0).cast("long")
    counts = stacked.select(train.alias("_t"), F.explode("plain").alias("c")).groupBy("c.block", "c.feature").agg(
        F.count(F.lit(1)).alias("df"), F.sum("_t").alias("_train")
    )
    return counts.unionByName(packed.counted(stacked)) if packed.names(stacked.columns) else counts


def fit_stacked(stacked: DataFrame, blocks: Sequence[Block], both_splits: bool = False) -> DataFrame:
    """``fit_features`` of the long table of ``stack_rows``, with each block's own ``min_df``."""
    return _fit_counts(count_stacked(stacked), {b.name: b.min_df for b in blocks}, both_splits)


def stacked_vectors(
    stacked: DataFrame, blocks: Sequence[Block], fitted: DataFrame, rows: int | None = None, extra: Sequence[str] = (),
    most: int | None = None,
) -> DataFrame:
    """``pack_vectors`` of the ``indexed`` cells of ``stack_rows``. While the fitted features are measured
    small, a listing's vector is made from its own row and nothing is shuffled. More than ``most`` hashed features
    go to every worker as a bit each, if their indices follow their texts; else the long table is joined."""
    spark, names = stacked.sparkSession, packed.names(stacked.columns)
    by_number, by_text = fitted.where(F.col("block").isin(names)), fitted.where(~F.col("block").isin(names))
    small, wide = by_number.count() <= (PLACES if most is None else most), None
    if not small:
        wide = {name: packed.fitted_places(by_number, name) for name in names}
        weights = _counts_of(by_number, stacked) if rows is not None else {}
    if not fits(by_text) or not small and (weights is None or None in wide.values()):
        cells = indexed(unstacked(stacked), fitted, rows)
        return pack_vectors(cells, fitted, stacked, extra)
    order = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]) if names else F.create_map()
    key = F.shiftleft(order[F.col("block")].cast("long"), 32).bitwiseOR(F.col("feature").cast("long"))
    place = F.coalesce(F.col("index"), F.lit(-1)).cast("int").alias("place")
    keys, places, counts = [], [], []
    if names and small:
        found = by_number.select(key.alias("key"), place, "df").toArrow()
        keys, places, counts = (found[c].to_numpy() for c in ("key", "place", "df"))
    few = by_text.select(*KEY, place, "df").collect()
    weight = lambda df: np.log((rows + 1) / (np.asarray(df, np.float64) + 1)) + 1 if rows is not None else np.ones(len(df))
    sort = np.argsort(keys)
    numbers = tuple(np.asarray(x)[sort] for x in (keys, places, weight(counts)))
    texts = {(r["block"], r["feature"]): (r["place"], w) for r, w in zip(few, weight([r["df"] for r in few]))}
    shared = spark.sparkContext.broadcast((numbers if small else (wide, weights), texts))
    size = fitted.agg((F.max("index") + 1).cast("int")).first()[0] or 0
    own = ["listing_id", *extra]
    fields = [f for f in stacked.schema.fields if f.name in own]
    fields.sort(key=lambda f: own.index(f.name))
    out = T.StructType([*fields, T.StructField("features", VectorUDT.sqlType())])
    vector = ["type", "size", "indices", "values"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, texts = shared.value
        for batch in (piece for batch in batches for piece in packed.pieces(batch)):
            columns = dict(zip(batch.schema.names, batch.columns))
            n = batch.num_rows
            parts = []
            for i, name in enumerate(names):
                row, bucket, value = packed.cells(batch, name)
                if not small:
                    places, counts = numbers
                    place = places[name].of(bucket)
                    df = counts[name].of(bucket) if rows is not None else place + 1
                    hit = df > 0
                    parts.append((row[hit], place[hit].astype(np.int32), value[hit] * weight(df[hit])))
                    continue
                known, places, weights = numbers
                key = bucket | i << 32
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[at] == key if len(known) else np.zeros(len(key), bool)
                at = at[hit]
                parts.append((row[hit], places[at], value[hit] * weights[at]))
            row, block, feature, value = _plain_cells(columns["plain"])
            block, feature = block.dictionary_encode(), feature.dictionary_encode()
            wide = max(len(feature.dictionary), 1)
            pair, which = np.unique(block.indices.to_numpy().astype(np.int64) * wide + feature.indices.to_numpy(), return_inverse=True)
            of_block, of_feature = block.dictionary.to_pylist(), feature.dictionary.to_pylist()
            answers = [texts.get((of_block[p // wide], of_feature[p % wide]), (-2, 0.0)) for p in pair.tolist()]
            place = np.array([a for a, _ in answers], np.int32)[which]
            share = np.array([w for _, w in answers], np.float64)[which]
            hit = place > -2
            parts.append((row[hit], place[hit], value[hit] * share[hit]))
            row, place, value = (np.concatenate(x) for x in zip(*parts))
            if rows is not None:
                value = value / np.sqrt(np.bincount(row, value * value, minlength=n))[row]
            row, place, value = (x[place >= 0] for x in (row, place, value))
            order = np.argsort(row << 32 | place)
            ends = _offsets(row, n)
            found = [
                pa.repeat(pa.scalar(0, pa.int8()), n), pa.repeat(pa.scalar(size, pa.int32()), n),
                *[pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (place, value)],
            ]
            features = pa.StructArray.from_arrays(found, vector)
            yield pa.RecordBatch.from_arrays([*[columns[c] for c in own], features], [*own, "features"])

    path = fresh_path(spark, "vectors")
    stacked.select(*own, *_of(_held(stacked))).mapInArrow(run, out).write.parquet(path)
    return spark.read.schema(T.StructType([*fields, T.StructField("features", VectorUDT())])).parquet(path)

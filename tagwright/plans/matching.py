"""Registered queries: brand filling and approximate matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.operators import match
from tagwright.plans import inputs
from tagwright.plans.oracles import BRAND_WORD, over, plain, text
from tagwright.plans.registry import query
from tagwright.sources import fixtures
from tagwright.sources.shared import publish


@query(over("brand_words", "SELECT brand, n, contains(brand, ' ') AS multi FROM brand_words"))
def brand_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return match.brand_dictionary(inputs.unified(spark, d))


@query(
    over(
        "brand_words",
        """SELECT u.listing_id, CASE WHEN u.brand_name <> '' THEN u.brand_name
             ELSE coalesce(a.brand, b.brand, s.w, '') END AS brand_name
           FROM unified u
           LEFT JOIN brand_words a ON contains(a.brand, ' ') AND a.brand = regexp_extract(u.name, '^{w}\\s{w}')
           LEFT JOIN brand_words b ON contains(b.brand, ' ') AND b.brand = regexp_extract(u.item_description, '^{w}\\s{w}')
           LEFT JOIN singles s ON s.listing_id = u.listing_id""".format(w=BRAND_WORD.replace("'", "''")),
        words="""SELECT listing_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
            SELECT listing_id, list_concat(regexp_extract_all(name, {w}), regexp_extract_all(item_description, {w})) AS ws
            FROM unified WHERE brand_name = '')""".format(w=text(BRAND_WORD)),
        singles="""SELECT listing_id, arg_min(w, i) AS w FROM words JOIN brand_words ON brand = w
            WHERE NOT contains(brand, ' ') GROUP BY 1""",
    )
)
def brand_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.unified(spark, d)
    brands = publish(match.brand_dictionary(rows), "brands")
    return match.brand_fill(rows, brands).select("listing_id", "brand_name")


WORDS = """SELECT word, count(*) AS freq FROM (
    SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY 1"""
PROBES = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS probe FROM benchmark"
# Words of one letter share no delete key with another letter.
PAIRS = """SELECT probe, word, freq, CAST(damerau_levenshtein(probe, word) AS INT) AS dist FROM probes JOIN words
    ON abs(length(probe) - length(word)) <= 1
    WHERE damerau_levenshtein(probe, word) <= 1 AND NOT (length(probe) = 1 AND length(word) = 1 AND probe <> word)"""
RANKED = """SELECT *, row_number() OVER (PARTITION BY probe ORDER BY dist, freq DESC, word) AS rank,
    min(dist) OVER (PARTITION BY probe) AS least FROM pairs"""


@query(
    plain(
        """SELECT DISTINCT CASE WHEN length(k) > 40 THEN md5(k) ELSE k END AS del_key, word FROM (
             SELECT word, unnest(list_transform(range(1, length(word) + 1),
               lambda i: substr(word, 1, i - 1) || substr(word, i + 1))) AS k FROM words WHERE length(word) > 1)""",
        words=WORDS,
    )
)
def deletes_index(spark: SparkSession, d: str) -> DataFrame:
    return match.deletes_index(match.word_counts(fixtures.dictionary_words(spark, d)))


@query(plain("SELECT probe, word, freq, dist FROM pairs", words=WORDS, probes=PROBES, pairs=PAIRS))
def fuzzy_join(spark: SparkSession, d: str) -> DataFrame:
    words = match.fitted_words(fixtures.dictionary_words(spark, d))
    return match.fuzzy_join(fixtures.probe_words(spark, d), words).select("probe", "word", "freq", "dist")


@query(
    plain(
        "SELECT probe, word, freq, dist, rank FROM ranked WHERE dist = least",
        words=WORDS,
        probes=PROBES,
        pairs=PAIRS,
        ranked=RANKED,
    )
)
def fuzzy_suggest(spark: SparkSession, d: str) -> DataFrame:
    words = match.fitted_words(fixtures.dictionary_words(spark, d))
    found = match.fuzzy_suggest(fixtures.probe_words(spark, d), words)
    return found.select("probe", "word", "freq", "dist", F.col("rank").cast("long").alias("rank"))


@query(
    plain(
        "SELECT probe, word, freq, dist, rank FROM ranked",
        words=WORDS,
        probes=PROBES,
        pairs=PAIRS,
        ranked=RANKED,
    )
)
def suggest_sort(spark: SparkSession, d: str) -> DataFrame:
    words = match.fitted_words(fixtures.dictionary_words(spark, d))
    found = match.fuzzy_suggest(fixtures.probe_words(spark, d), words, mode="all")
    return found.select("probe", "word", "freq", "dist", F.col("rank").cast("long").alias("rank"))


@query(
    plain(
        "SELECT p.probe, r.word, r.freq, r.dist FROM probes p LEFT JOIN ranked r ON r.probe = p.probe AND r.rank = 1",
        words=WORDS,
        probes=PROBES,
        pairs=PAIRS,
        ranked=RANKED,
    )
)
def fuzzy_best(spark: SparkSession, d: str) -> DataFrame:
    words = match.fitted_words(fixtures.dictionary_words(spark, d))
    return match.fuzzy_best(fixtures.probe_words(spark, d), words).select("probe", "word", "freq", "dist")


@query(
    plain(
        """SELECT probe, word, CAST(damerau_levenshtein(probe, word) AS INT) AS dist FROM pairs""",
        words=WORDS,
        probes=PROBES,
        pairs=PAIRS,
    )
)
def edit_distance_pairs(spark: SparkSession, d: str) -> DataFrame:
    words = match.fitted_words(fixtures.dictionary_words(spark, d))
    return match.fuzzy_join(fixtures.probe_words(spark, d), words).select("probe", "word", "dist")


# Two edits with each part edited once: the built-in distance also allows edits between swapped
# characters, so where only that reaches 2, the swap is looked for beside at most one other edit.
# Words of up to two letters without a letter in common share no delete key.
PAIRS_TWO = """SELECT probe, word, freq, CAST(dl AS INT) AS dist FROM (
    SELECT probe, word, freq, damerau_levenshtein(probe, word) AS dl FROM probes CROSS JOIN words
    WHERE abs(length(probe) - length(word)) <= 2
      AND NOT (length(probe) <= 2 AND length(word) <= 2 AND NOT contains(word, substr(probe, 1, 1))
               AND NOT (length(probe) = 2 AND contains(word, substr(probe, 2, 1)))))
  WHERE dl <= 1 OR dl = 2 AND (levenshtein(probe, word) = 2 OR list_bool_or(list_transform(
    range(1, length(probe)), lambda i: list_bool_or(list_transform([i - 1, i, i + 1], lambda j:
      j > 0 AND substr(word, j, 1) = substr(probe, i + 1, 1) AND substr(word, j + 1, 1) = substr(probe, i, 1)
      AND length(word) > j
      AND damerau_levenshtein(substr(probe, 1, i - 1), substr(word, 1, j - 1))
        + damerau_levenshtein(substr(probe, i + 2), substr(word, j + 2)) <= 1)))))"""


@query(
    plain(
        "SELECT probe, word, freq, dist, rank FROM ranked",
        words=WORDS,
        probes=PROBES,
        pairs=PAIRS_TWO,
        ranked=RANKED,
    )
)
def fuzzy_suggest_two(spark: SparkSession, d: str) -> DataFrame:
    """Two edits, all suggestions."""
    words = match.fitted_words(fixtures.dictionary_words(spark, d))
    found = match.fuzzy_suggest(fixtures.probe_words(spark, d), words, k=2, mode="all")
    return found.select("probe", "word", "freq", "dist", F.col("rank").cast("long").alias("rank"))

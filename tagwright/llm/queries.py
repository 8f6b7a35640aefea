"""The registered queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.llm import (
    bpe,
    html_text,
    license_scan,
    packing,
    pii,
    prefix_trie,
    quality,
    secret_scan,
    simhash,
    token_index,
    topk,
    toxicity,
    variants,
)
from tagwright.sources.shared import publish

QUERIES = {}
ORACLES: dict[str, str] = {}

# The vocabulary every query of tokens uses; operators take any path.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# Where DuckDB can say the same. The others need fitted models, 64-bit hashes, tokenizers or the
# position of every match, and are tested against brute force.
ORACLES["op2_quality_rules"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS times
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM windows CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)
  WHERE times > 1 GROUP BY 1),
s AS (
  SELECT w.*, CAST(len(words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered c USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_symbols <= 20 * n_words AND 2 * n_dup_lines <= len(lines)
    AND word_chars BETWEEN 2 * n_words AND 20 * n_words
    AND 100 * len(list_filter(words, lambda x: NOT regexp_matches(x, '\p{L}'))) <= 50 * n_words
    AND 100 * len(list_filter(words, lambda x: regexp_matches(x, '^[^\p{Ll}]*\p{Lu}{2}[^\p{Ll}]*$'))) <= 50 * n_words AS kept
FROM f"""

ORACLES["op5_maxscore_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


def crc32_sql(text: str) -> str:
    """The CRC-32 of a string's UTF-8 bytes, bit by bit."""
    eight = "list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0])"
    step = "CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::BIGINT) ELSE y // 2 END"
    data = f"hex(encode({text}))"
    bytes_ = f"list_transform(range(0, len({data}) // 2), lambda i: CAST(concat('0x', substr({data}, 2 * i + 1, 2)) AS BIGINT))"
    return (
        f"xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_}), "
        f"lambda c, b: list_reduce({eight}, lambda y, z: {step})), 4294967295::BIGINT)"
    )


ORACLES["op11_prefix_trie"] = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS turns FROM t GROUP BY 1),
heads AS (SELECT *, {crc32_sql('CAST(conv_id AS VARCHAR)')} % 6 AS h, conv_id - (conv_id % 100 + 100) % 100 AS base FROM own),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
  FROM heads a LEFT JOIN own b ON b.conv_id = a.base),
members AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '') AS ends
  FROM members GROUP BY 1, 2),
children AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
facts AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children,
    CASE WHEN n.depth > 0 THEN (n_convs - 1) * length(n.path[n.depth].text) ELSE 0 END AS saved
  FROM nodes n LEFT JOIN children c ON c.path = n.path AND c.depth = n.depth),
above AS (SELECT path, depth, n_children, saved, unnest(range(0, depth + 1)) AS up FROM facts),
sums AS (
  SELECT path[1:up] AS path, up AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved
  FROM above GROUP BY 1, 2)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM facts f JOIN sums s ON s.path = f.path AND s.depth = f.depth
LEFT JOIN facts p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.path = f.path[1:f.depth - 1]"""


ORACLES["op12_spelling_variants"] = f"""
WITH r AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id,
      translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{6,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents) GROUP BY 1, 2),
h AS (SELECT run, times, {crc32_sql("concat(doc_id, ':', run)")} AS h FROM r),
w AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT times, CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2))
      ELSE run END AS word FROM h)
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(times) >= 5),
cuts AS (SELECT word, n, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT *, unnest(range(0, length(word))) AS i FROM w)),
shorter AS (SELECT DISTINCT c.word AS word, c.n AS n, v.word AS near, v.n AS near_n FROM cuts c JOIN w v ON v.word = concat(c.a, c.b)),
pairs AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM cuts x JOIN cuts y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT word, near, near_n FROM shorter UNION ALL SELECT near, word, n FROM shorter),
best AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS place, count(*) OVER (PARTITION BY word) AS n_near
  FROM pairs),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 5 * w.n THEN b.near END AS form,
    CASE WHEN b.near_n >= 5 * w.n THEN b.near_n END AS form_n
  FROM w LEFT JOIN best b ON b.word = w.word AND b.place = 1),
chain AS (
  WITH RECURSIVE c AS (
    SELECT word, word AS here, 0 AS d FROM formed
    UNION ALL SELECT c.word, f.form, d + 1 FROM c JOIN formed f ON f.word = c.here WHERE f.form IS NOT NULL)
  SELECT word, arg_max(here, d) AS root FROM c GROUP BY 1)
SELECT f.*, c.root FROM formed f JOIN chain c USING (word)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates are found in one scan and written with their votes (ids and numbers, no text);
    fitting and reporting read them from there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = publish(pii.detect(docs).drop("text"), "pii")
    return pii.report(found, pii.fit(found))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op5_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors)


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


@query
def op7_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query
def op9_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations share the first turns of the one at the hundred below them; how many is by a
    checksum of their id."""
    ids = F.col("conv_id").cast("long")
    head = F.crc32(ids.cast("string").cast("binary")) % 6
    records = prefix_trie.paths(table(spark, sf_dir, "conversations"), ids - F.pmod(ids, F.lit(100)), head)
    return prefix_trie.trie(records)


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, of which one in 199 runs of letters has lost a code point."""
    docs = table(spark, sf_dir, "documents")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # Shorter runs give no word of six code points.
    found = docs.select(key.alias("key"), F.explode(variants.runs(F.col("text").cast("string"), 6)).alias("run"))
    found = found.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    words = found.select(F.when(F.col("h") % 199 == 0, cut).otherwise(F.col("run")).alias("word"))
    return variants.variants(publish(variants.counted(words), "words"))


@query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan.scan(table(spark, sf_dir, "documents"))
    return license_scan.report(scanned).drop("spans")

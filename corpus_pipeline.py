"""From raw documents to packed training sequences, stage by stage.

Every stage works on all rows the one before kept. ``run`` writes each stage's rows to the shared
folder and reads them again, so a lost executor costs a re-read and no stage is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagwright.llm import packing, pii, quality, simhash, toxicity
from tagwright.llm.queries import TOKENIZER, table
from tagwright.sources.shared import publish

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents graded toxic go."""
    docs = docs.select(COLUMNS)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.keep(docs.select(COLUMNS))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, the one of the least id."""
    return simhash.deduplicate(docs.select(COLUMNS))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by marks of its kind."""
    return pii.redact(docs.select(COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in training sequences. The earlier stages have grown
    the executors' heaps by now, so the encoders remember less than where they have one to themselves."""
    return packing.pack(docs, TOKENIZER, remembered=60_000, chars=1_000_000)


STAGES = [
    ("toxicity", without_toxic),
    ("quality_rules", of_quality),
    ("simhash_near_dedup", without_copies),
    ("pii", without_personal_data),
    ("best_fit_packing", packed),
]

# Fitted models, fingerprints and tokens have no SQL form; the tests hold the stages against
# brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = publish(stage(spark, docs, sf_dir), name)
    return docs

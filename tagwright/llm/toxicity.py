"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are a document's words and the first ``PREFIXES`` letters of its words. Those are kept that
come with toxic labels far more often than without (a signed likelihood-ratio test on the documents
fitted on, of which there are at most ``2 * FIT_DOCUMENTS``). One weight vector is shared by all thresholds:
``P(grade <= k) = sigmoid(threshold_k - weights . x)``.

Labels only say toxic or not. A toxic document's grade 1..``GRADES`` is how often the kept features
occur in it (``GRADE_EDGES``), so the model orders documents by how much of their text is toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.sources.shared import publish

WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
# At most this many features are kept, each in this many toxic documents at least and with this
# likelihood ratio (chi-squared with one degree of freedom; 30 is far beyond chance for a vocabulary).
MAX_FEATURES = 4096
MIN_DOCUMENTS = 4
MIN_RATIO = 30.0
# Labelled documents that features and weights are fitted on: this many of each label at most.
FIT_DOCUMENTS = 20_000
# Occurrences of kept features from which a toxic document has grade 2, 3, ...
GRADE_EDGES = (2, 4)
GRADES = len(GRADE_EDGES) + 1


def features_of(text: str | None) -> Counter:
    """Lower-case words (no digits, no marks) and, as ``pre*``, the prefixes of longer words."""
    found: Counter = Counter()
    for word, n in Counter(WORDS.findall((text or "").lower())).items():
        found[word] += n
        for size in PREFIXES:
            if len(word) > size:
                found[word[:size] + "*"] += n
    return found


def _exploded(labelled: DataFrame) -> DataFrame:
    """One row per distinct feature of a labelled document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(features_of(text))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found), pa.array(np.full(len(found), toxic, np.int32))], ["feature", "toxic"]
                    )

    return labelled.select(F.col("toxic").cast("int"), "text").mapInArrow(run, "feature string, toxic int")


def choose_features(labelled: DataFrame, limit: int = MAX_FEATURES) -> list[str]:
    """The features that mark toxic documents, by falling likelihood ratio (ties by name).

    Counts are summed before the shuffle; what comes back is at most ``limit`` names.
    """
    totals = labelled.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not totals[0] or not totals[1]:
        return []
    counts = _exploded(labelled).groupBy("feature").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")
    )
    positive, negative = (float(x) for x in totals)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    share = (a + b) / (positive + negative)
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = 2 * (
        term(a, share * positive)
        + term(b, share * negative)
        + term(positive - a, (1 - share) * positive)
        + term(negative - b, (1 - share) * negative)
    )
    kept = counts.withColumn("ratio", ratio).where(
        (F.col("a") >= MIN_DOCUMENTS) & (ratio >= MIN_RATIO) & (a / positive > 4 * b / negative)
    )
    return [r[0] for r in kept.orderBy(F.desc("ratio"), "feature").limit(limit).select("feature").collect()]


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by feature and rising thresholds between grades 0..``GRADES``."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    thresholds: tuple[float, ...]

    def over(self, x: np.ndarray) -> np.ndarray:
        """``P(grade > k)`` for each document (row) and threshold k (column)."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - x[:, None], -30, 30)))


def _values(counts: list[Counter], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: document, feature and ``1 + log(occurrences)``."""
    rows, columns, values = [], [], []
    for i, found in enumerate(counts):
        for feature, n in found.items():
            j = number.get(feature)
            if j is not None:
                rows.append(i)
                columns.append(j)
                values.append(1 + np.log(n))
    return np.array(rows, np.int64), np.array(columns, np.int64), np.array(values)


def _grades(counts: list[Counter], toxic: np.ndarray, number: dict[str, int]) -> np.ndarray:
    """0 without the label; else by occurrences of whole kept words, or of the prefixes if there are
    none."""
    out = np.zeros(len(counts), np.int64)
    for i, found in enumerate(counts):
        if toxic[i]:
            words = sum(n for f, n in found.items() if f in number and not f.endswith("*"))
            prefixes = max([0, *(n for f, n in found.items() if f in number and f.endswith("*"))])
            out[i] = 1 + np.searchsorted(GRADE_EDGES, max(words, prefixes), side="right")
    return out


def _minimise(rows, columns, values, grades, size: int, steps: int = 1000, penalty: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Proportional-odds likelihood by gradient ascent with per-coordinate steps (Adam). Thresholds
    are a first value and positive gaps, so they stay in order."""
    n = len(grades)
    theta = np.zeros(size + GRADES)
    theta[size] = 1.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        weights, gaps = theta[:size], np.exp(theta[size + 1 :])
        cuts = np.concatenate([[theta[size]], theta[size] + np.cumsum(gaps)])
        x = np.bincount(rows, values * weights[columns], n) if len(rows) else np.zeros(n)
        below = 1 / (1 + np.exp(-np.clip(cuts[None, :] - x[:, None], -30, 30)))
        padded = np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))])
        slope = padded * (1 - padded)
        at = np.arange(n)
        p = np.maximum(padded[at, grades + 1] - padded[at, grades], 1e-9)
        upper, lower = slope[at, grades + 1] / p, slope[at, grades] / p
        by_x = -(upper - lower) / n
        by_cut = np.bincount(grades, upper / n, GRADES + 1)[:GRADES] - np.bincount(grades, lower / n, GRADES + 1)[1:]
        gradient = np.empty_like(theta)
        gradient[:size] = np.bincount(columns, values * by_x[rows], size) if len(rows) else 0
        gradient[:size] -= penalty * weights
        gradient[size] = by_cut.sum()
        gradient[size + 1 :] = np.cumsum(by_cut[::-1])[::-1][1:] * gaps
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:size], np.concatenate([[theta[size]], theta[size] + np.cumsum(np.exp(theta[size + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCUMENTS) -> OrdinalModel:
    """Features and weights from a bounded sample of the labelled documents: of each label the
    ``limit`` with the least hash of their id.

    The sample's ids are bounded, so they are broadcast and no text but the sample's is shuffled. Rows
    that repeat an id count once, with the least of their texts. Labels other than 0
    and 1 and labels without a document do not count; a document labelled both ways is toxic.
    Without documents of both labels nothing is toxic.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [known.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for x in (0, 1)]
    sample = publish(drawn[0].unionByName(drawn[1]), "labels")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    drawn_rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id")
    labelled = publish(drawn_rows.agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")), "labelled")
    chosen = choose_features(labelled)
    if not chosen:
        return OrdinalModel((), (), tuple(30.0 + k for k in range(GRADES)))
    number = {f: i for i, f in enumerate(chosen)}

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [{f: n for f, n in features_of(t).items() if f in number} for t in batch.column(1).to_pylist()]
            lists = [pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["toxic", "features", "counts"])

    rows = labelled.select("toxic", "text").mapInArrow(
        kept, "toxic int, features array<string>, counts array<int>"
    ).collect()
    counts = [Counter(dict(zip(r[1], r[2]))) for r in rows]
    toxic = np.array([r[0] for r in rows], np.int64)
    grades = _grades(counts, toxic, number)
    weights, thresholds = _minimise(*_values(counts, number), grades, len(chosen))
    return OrdinalModel(tuple(chosen), tuple(weights.tolist()), tuple(thresholds.tolist()))


def _scores(texts: list[str | None], model: OrdinalModel, weight: dict[str, float]) -> np.ndarray:
    x = np.zeros(len(texts))
    for i, text in enumerate(texts):
        found: Counter = Counter()
        for word, n in Counter(WORDS.findall((text or "").lower())).items():
            if word in weight:
                found[word] += n
            for size in PREFIXES:
                if len(word) > size and word[:size] + "*" in weight:
                    found[word[:size] + "*"] += n
        x[i] = sum(weight[f] * (1 + np.log(n)) for f, n in found.items())
    return model.over(x)


def score(docs: DataFrame, model: OrdinalModel, cut: float = 0.5) -> DataFrame:
    """``doc_id, expected_severity, grade, toxic`` for every row.

    The expected severity is the sum of ``P(grade > k)``; ``grade`` is the most likely one; ``toxic``
    says that ``P(grade > 0)`` reaches ``cut``. Null texts count as empty; repeated rows are scored
    alike; other columns are not read. The model holds at most ``MAX_FEATURES`` weights.
    """
    weight = dict(zip(model.features, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            over = _scores(batch.column(1).to_pylist(), model, weight)
            chance = -np.diff(np.hstack([np.ones((len(over), 1)), over, np.zeros((len(over), 1))]), axis=1)
            columns = [batch.column(0), pa.array(over.sum(axis=1)), pa.array(chance.argmax(axis=1).astype(np.int32)), pa.array(over[:, 0] >= cut)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "expected_severity", "grade", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, expected_severity double, grade int, toxic boolean"
    )


def keep_clean(docs: DataFrame, model: OrdinalModel, cut: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns, in one pass without a join."""
    weight = dict(zip(model.features, model.weights))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            over = _scores(batch.column(at).to_pylist(), model, weight)
            yield batch.filter(pa.array(over[:, 0] < cut))

    return docs.mapInArrow(run, docs.schema)

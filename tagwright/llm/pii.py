"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose candidate spans. Four labelers vote on each: format, gazetteer, context and
surroundings (for, against, or no vote). Expectation-maximisation over the counts of vote patterns
estimates, for each kind, how reliable each labeler is and thereby how likely each candidate is
personal. A logistic classifier is then trained on these posteriors; it sees no votes but the span:
its kind, length, share of digits, shape and the (hashed) word before it. A text's
regular-expression ("base") spans are always kept, the classifier decides on the others. What
reaches the driver are counts per kind and vote pattern, at most ``len(KINDS) * 3 ** len(LABELERS)``
rows, and per look of a span, at most ``len(KINDS)`` times the product of ``LOOKS`` (40,320).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.llm.spans import counted, let, matches, redacted, written
from tagwright.sources.shared import publish

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "name", "national_id", "iban", "account", "local_phone"]
LABELERS = ["by_format", "by_gazetteer", "by_context", "by_surroundings"]
MARKS = [f"<{k.upper()}>" for k in KINDS]
# What the classifier sees of a span, and how many values each has.
LOOKS = {"length": 7, "digits": 5, "shape": 4, "word": 32}

# The base patterns, written so that Java needs linear time: a run of characters is entered at its
# first character (or where the last match ended) only, and loops never give back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGITS = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@dataclass(frozen=True)
class Gazetteers:
    """The lists that spans are looked up in, each as alternatives of a regular expression."""

    titles: str = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra"
    names: str = (
        "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|David|Elizabeth|William|Barbara|Richard|Susan|Joseph|"
        "Jessica|Thomas|Sarah|Charles|Karen|Anna|Peter|Hans|Klaus|Marie|Jean|Pierre|Sophie|Maria|Jose|Juan|Carmen"
    )
    endings: str = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info"
    calling: str = "1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-8]"
    issuers: str = "4|5[1-5]|34|37|6011|35"
    iban_countries: str = "AT|BE|CH|DE|ES|FR|GB|IE|IT|LU|NL|PL|PT"
    area_codes: str = "[2-9][0-8][0-9]"
    # Numbers that were printed in advertisements, and areas that were ever given out.
    sample_ids: str = "078051120|219099999|457555462|123456789"
    id_areas: str = "[0-6][0-9]{2}|7[0-6][0-9]|77[0-2]"

    @property
    def name_pattern(self) -> str:
        person = r"\x20\p{Lu}\p{L}++"
        return rf"(?<!\p{{L}})(?:(?:{self.titles})\.?{person}(?:{person})?|(?:{self.names}){person})"


LISTS = Gazetteers()
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
GROUPED = r"^(?:[0-9]++|(?:[0-9]{4}[\x20-]){2,4}[0-9]{1,4}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{4,5})$"
LOCAL_PHONE = r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])"

FOR = {
    "email": "mail|contact|write|address",
    "ip": r"\bip\b|address|host|server|login",
    "card": "card|visa|master|credit|pay",
    "phone": "phone|tel|call|mobile|fax|cell",
    "name": "name|contact|signed|regards|dear|author",
    "national_id": "ssn|social|national|passport|tax",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "account": "card|account|credit|visa|bank|customer",
    "local_phone": "phone|tel|call|mobile|fax|cell",
}
AGAINST = {
    "email": "example only|noreply",
    "ip": r"version|release|build|section|\bv$",
    "card": "isbn|order|serial|tracking|part",
    "phone": "isbn|order|serial|version",
    "name": "street|university|company|hotel",
    "national_id": "part|model|order|serial",
    "iban": "model|part|serial|product",
    "account": "isbn|order|serial|tracking|part|invoice",
    "local_phone": "isbn|order|serial|version|part",
}


def _vote(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(yes, 1)
    return F.coalesce((vote if no is None else vote.when(no, -1)).otherwise(0), F.lit(0)).cast("byte")


def _votes(kind: str, m: Column, lists: Gazetteers) -> list[Column]:
    """The four labelers' votes on a match, in the order of ``LABELERS``."""
    hit, before = m["hit"], F.lower(m["before"])
    digits = F.regexp_replace(hit, "[^0-9]", "")
    formats = {
        "email": _vote(hit.rlike(r"^[A-Za-z0-9]") & hit.rlike(r"\.[A-Za-z]{2,}$")),
        "ip": _vote(~hit.rlike(r"(?:^|\.)0[0-9]"), F.lit(True)),
        "card": _vote(hit.rlike(GROUPED), F.lit(True)),
        "phone": _vote(F.length(digits).between(10, 13)),
        "name": _vote(hit.rlike(rf"^(?:{lists.titles})\b")),
        "national_id": _vote(~hit.rlike("^(?:000|666|9)|-00-|-0000$"), F.lit(True)),
        "iban": _vote(F.length(F.replace(hit, F.lit(" "))).between(15, 34), F.lit(True)),
        "account": _vote(hit.rlike(GROUPED), F.lit(True)),
        "local_phone": _vote(~digits.rlike("^[01]"), F.lit(True)),
    }
    issuers = digits.rlike(f"^(?:{lists.issuers})")
    gazetteers = {
        "email": _vote(hit.rlike(rf"\.(?:{lists.endings})$")),
        "ip": _vote(hit.rlike(r"^(?:10|127|0)\.|^192\.168\.|^169\.254\.") == F.lit(False), F.lit(True)),
        "card": _vote(issuers, F.lit(True)),
        "phone": _vote(hit.rlike(rf"^\+(?:{lists.calling})"), F.lit(True)),
        "name": _vote(hit.rlike(rf"\b(?:{lists.names})\b")),
        "national_id": _vote(
            digits.rlike(f"^(?:{lists.id_areas})") & ~digits.rlike(f"^(?:{lists.sample_ids})$"), F.lit(True)
        ),
        "iban": _vote(hit.rlike(f"^(?:{lists.iban_countries})"), F.lit(True)),
        "account": _vote(issuers, F.lit(True)),
        "local_phone": _vote(digits.rlike(f"^(?:{lists.area_codes})"), F.lit(True)),
    }
    glued = m["after"].rlike(r"^[\p{L}0-9_]") | before.rlike(r"[\p{L}0-9_]$")
    return [
        formats[kind],
        gazetteers[kind],
        _vote(before.rlike(FOR[kind]), before.rlike(AGAINST[kind])),
        _vote(~glued, glued),
    ]


def _looks(m: Column) -> list[Column]:
    """A span's values in ``LOOKS``: octaves of length, fifths of digits, capitals and separators,
    and a bucket of the word before it (0 if there is none)."""
    hit, size = m["hit"], F.length(m["hit"])
    word = F.lower(F.regexp_extract(m["before"], r"(\p{L}+)[^\p{L}]*$", 1))
    looks = {
        "length": F.least(F.floor(F.log2(size)), F.lit(LOOKS["length"] - 1)),
        "digits": F.floor(F.length(F.regexp_replace(hit, "[^0-9]", "")) * (LOOKS["digits"] - 1) / size),
        "shape": F.when(hit.rlike(r"\p{Lu}"), 1).otherwise(0) + F.when(hit.rlike(r"[\x20().-]"), 2).otherwise(0),
        "word": F.when(word == "", 0).otherwise(1 + F.pmod(F.xxhash64(word), F.lit(LOOKS["word"] - 1))),
    }
    return [looks[n].cast("byte").alias(n) for n in LOOKS]


def _spans(kind: str, found: Column, lists: Gazetteers, keep=None, base: bool = False) -> Column:
    def span(m: Column) -> Column:
        votes = [v.alias(n) for n, v in zip(LABELERS, _votes(kind, m, lists))]
        head = [m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")]
        return F.struct(*head, F.lit(base).alias("base"), *votes, *_looks(m))

    kept = found if keep is None else F.filter(found, keep)
    return F.transform(kept, span)


def candidates(text: Column, lists: Gazetteers = LISTS) -> Column:
    """Every candidate span of the whole text with its votes and looks; none for a null or empty text."""

    def luhn(m: Column) -> Column:
        digits = F.regexp_replace(m["hit"], "[^0-9]", "")
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)

    def unlucky(m: Column) -> Column:
        digits = F.regexp_replace(m["hit"], "[^0-9]", "")
        return F.length(digits).between(13, 19) & ~F.call_function("luhn_check", digits)

    number = text.rlike("[0-9]")
    return F.concat(
        _spans("email", matches(text, EMAIL, F.contains(text, F.lit("@"))), lists, base=True),
        _spans(
            "ip",
            matches(text, IP, number & text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
            lists,
            lambda m: m["hit"].rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"),
            base=True,
        ),
        let(
            matches(text, DIGITS, number & text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")),
            lambda found: F.concat(_spans("card", found, lists, luhn, base=True), _spans("account", found, lists, unlucky)),
        ),
        _spans(
            "phone",
            matches(text, PHONE, F.contains(text, F.lit("+"))),
            lists,
            lambda m: F.length(F.regexp_replace(m["hit"], "[^0-9]", "")).between(9, 15),
            base=True,
        ),
        _spans("name", matches(text, lists.name_pattern), lists),
        _spans("national_id", matches(text, NATIONAL_ID, number & text.rlike("[0-9]-[0-9]{2}-[0-9]{4}")), lists),
        _spans("iban", matches(text, IBAN, number & text.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}")), lists),
        _spans("local_phone", matches(text, LOCAL_PHONE, number & text.rlike("[0-9]{3}[.-][0-9]{4}")), lists),
    )


@dataclass(frozen=True)
class SpanClassifier:
    """Logistic weights per kind, for the kind itself and for each value in ``LOOKS``, and how often
    each labeler's votes agree with the posteriors they were estimated with."""

    weights: tuple[float, ...]
    reliabilities: tuple[float, ...]

    def keeps(self, span: Column) -> Column:
        weights = F.array(*[F.lit(float(w)) for w in self.weights])
        score = F.get(weights, span["kind"])
        for at, (name, values) in zip(_OFFSETS, LOOKS.items()):
            score = score + F.get(weights, F.lit(at) + span["kind"] * values + span[name])
        return span["base"] | (score >= 0)


# Where each look's weights begin: those of the kinds themselves come first.
_OFFSETS = [len(KINDS) * (1 + sum(list(LOOKS.values())[:i])) for i in range(len(LOOKS))]
_WEIGHTS = len(KINDS) * (1 + sum(LOOKS.values()))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple, float]:
    """The chance that a candidate is personal, by ``(kind, votes)``, from how often each pattern of
    votes occurs (``(kind, votes, n)``).

    Labelers are independent given the truth, with chances of their own for every kind; before any
    evidence a labeler is believed to be right more often than wrong.
    """
    beliefs = {}
    for kind in sorted({k for k, *_ in patterns}):
        votes = np.array([v for k, v, _ in patterns if k == kind])
        n = np.array([c for k, _, c in patterns if k == kind], float)
        belief = _sigmoid(votes.sum(axis=1))  # from the majority, a tie counting half
        for _ in range(rounds):
            prior = ((n * belief).sum() + 1) / (n.sum() + 2)
            odds = np.full(len(n), math.log(prior / (1 - prior)))
            for i in range(votes.shape[1]):
                sides = []
                for share, trusted in ((belief, 1), (1 - belief, -1)):
                    mass = {v: (n * share)[votes[:, i] == v].sum() + (3 if v == trusted else 1) for v in (1, 0, -1)}
                    sides.append({v: m / sum(mass.values()) for v, m in mass.items()})
                odds += [math.log(sides[0][v] / sides[1][v]) for v in votes[:, i].tolist()]
            belief = _sigmoid(odds)
        beliefs |= {(kind, tuple(v)): float(b) for v, b in zip(votes.tolist(), belief)}
    return beliefs


def logistic(on: np.ndarray, n: np.ndarray, target: np.ndarray, size: int, penalty: float = 1e-3) -> np.ndarray:
    """Weights of ``size`` zero-one features that maximise the likelihood of the shares ``target``
    among ``n`` rows less ``penalty / 2`` times the weights' squares, by gradient ascent. ``on`` has the
    features of each row; the first column is the group whose rows weigh one in all."""
    weights = np.zeros(size)
    if len(n):
        share = n / np.bincount(on[:, 0], n)[on[:, 0]]
        for _ in range(1000):
            miss = share * (target - _sigmoid(weights[on].sum(axis=1)))
            weights += np.bincount(on.ravel(), np.repeat(miss, on.shape[1]), size) - penalty * weights
    return weights


def fit(spans: DataFrame, rounds: int = 50, column: str = "candidates") -> SpanClassifier:
    """Posteriors by expectation-maximisation over vote patterns, then the classifier of spans.

    Two aggregations of ``spans`` (best a written table); what the driver works on does not grow
    with the input. Posteriors are added as whole millionths, so sums do not depend on their order.
    """
    exploded = spans.select(F.explode(column).alias("s")).select("s.*")
    voted = exploded.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n"))
    patterns = [(r[0], tuple(r[1:-1]), r[-1]) for r in sorted(tuple(r) for r in voted.collect())]
    beliefs = reliabilities(patterns, rounds)

    # The table of beliefs as one array, addressed by kind and votes.
    table = [beliefs.get((k, v), 0.5) for k in range(len(KINDS)) for v in product((-1, 0, 1), repeat=len(LABELERS))]
    at = F.col("kind")
    for name in LABELERS:
        at = at * 3 + F.col(name) + 1
    millionths = F.get(F.array(*[F.lit(round(b * 1e6)) for b in table]), at).cast("long")
    looked = exploded.groupBy("kind", *LOOKS).agg(F.count(F.lit(1)).alias("n"), F.sum(millionths).alias("sure"))
    cells = np.array(sorted(tuple(r) for r in looked.collect()), np.int64).reshape(-1, len(LOOKS) + 3)
    kind, n = cells[:, 0], cells[:, -2]
    on = [kind] + [at + kind * values + cells[:, i + 1] for i, (at, values) in enumerate(zip(_OFFSETS, LOOKS.values()))]
    weights = logistic(np.stack(on, axis=1), n, cells[:, -1] / 1e6 / np.maximum(n, 1), _WEIGHTS)

    agree = []
    for i in range(len(LABELERS)):
        cast = [(c, beliefs[k, v] if v[i] > 0 else 1 - beliefs[k, v]) for k, v, c in patterns if v[i]]
        agree.append(sum(c * b for c, b in cast) / sum(c for c, _ in cast) if cast else 0.5)
    return SpanClassifier(tuple(weights.tolist()), tuple(agree))


def detect(docs: DataFrame, text: str = "text", into: str = "candidates", lists: Gazetteers = LISTS) -> DataFrame:
    """``docs`` with an array of candidate spans. Nulls count as empty texts; other columns pass."""
    return docs.withColumn(into, candidates(F.coalesce(F.col(text), F.lit("")), lists))


def report(detected: DataFrame, model: SpanClassifier) -> DataFrame:
    """``doc_id``, base counts per kind, the digest of the base spans and all kept spans."""
    base = F.filter("candidates", lambda s: s["base"])
    kept = F.filter("candidates", model.keeps)
    return detected.select(
        "doc_id",
        *[
            counted("candidates", i, lambda s: s["base"]).alias(f"n_{k}") for i, k in enumerate(BASE)
        ],
        F.sha2(written(base, KINDS), 256).alias("base_sha256"),
        written(kept, KINDS).alias("spans"),
    )


def redact(docs: DataFrame, lists: Gazetteers = LISTS) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by a mark of its kind, ``n_chars`` renewed.

    Patterns are searched once; rows are written with their candidates, fitted on and then changed.
    Null texts stay null. All columns are kept; a column named like the operator's own working
    column is not touched.
    """
    own = "_candidates"
    while own in docs.columns:
        own = "_" + own
    found = publish(detect(docs, into=own, lists=lists), "pii")
    model = fit(found, column=own)
    detected = found.withColumn(own, F.filter(own, model.keeps))
    changed = detected.withColumn("text", redacted(F.col("text"), F.col(own), MARKS))
    if "n_chars" in docs.columns:
        changed = changed.withColumn(
            "n_chars", F.when(F.size(own) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        )
    return changed.select(*docs.columns)

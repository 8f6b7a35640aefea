"""Quality rules as a short-circuit cascade, with DataFrame functions only.

On a sample, the time each rule takes and what it rejects of the texts that the rules before it let
through are measured; the rule with the most such rejections per second comes next, and a text that
one rule rejects is not looked at by the next. The order changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.llm.spans import let
from tagwright.sources.shared import publish

SPACE = r"[\x20\x09-\x0D]+"
EDGES = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
# Rows that estimates are made on, as a mean (rows are drawn independently).
SAMPLE_ROWS = 1000
# A timed run repeats the sample until splitting its words alone takes this long.
LEAST_SECONDS = 0.25
RUNS = 3
# A rule goes before an earlier listed one only if it rejects this many times more per second.
CLEARLY = 1.5


def words_of(text: Column) -> Column:
    """Words of the whole text; none for null."""
    inner = F.btrim(text, F.lit(EDGES))
    return F.when(F.length(inner) > 0, F.split(inner, SPACE)).otherwise(F.array().cast("array<string>"))


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, ""))


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0))


def lines_of(text: Column) -> Column:
    """Lines with a word in them."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def n_repeat_words(words: Column, window: int = 3) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in the text.

    Windows are told apart by 64-bit hashes. If all differ, that is the answer; else hashes are
    sorted with their positions and equal neighbours mark theirs: n log n for a text of n words.
    """

    def hashed(words: Column) -> Column:
        rest = lambda i: [F.get(words, i + k) for k in range(1, window)]
        first = F.slice(words, F.lit(1), F.greatest(F.size(words) - (window - 1), F.lit(0)))
        return F.transform(first, lambda w, i: F.xxhash64(w, *rest(i)))

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(at: Column) -> Column:
            same = lambda s, j: F.coalesce(F.get(at, j)["h"] == s["h"], F.lit(False))
            twice = F.filter(at, lambda s, j: same(s, j - 1) | same(s, j + 1))
            inside = F.transform(twice, lambda s: F.sequence(s["i"], s["i"] + (window - 1)))
            return F.size(F.array_distinct(F.flatten(inside)))

        return let(ordered, marked)

    return let(
        hashed(words),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)),
    )


@dataclass(frozen=True)
class Rule:
    """``rejects(words, text)`` is true for a text that fails the rule; never null."""

    name: str
    rejects: Callable[[Column, Column], Column]


def _share(condition: Callable[[Column], Column], percent: int) -> Callable[[Column, Column], Column]:
    """More than ``percent`` of the words satisfy ``condition``."""
    return lambda words, _: 100 * F.size(F.filter(words, condition)) > percent * F.size(words)


# The two base rules come first in the list; the order they run in is estimated.
RULES = [
    Rule("too_short", lambda words, text: F.size(words) < 50),
    Rule("repeats", lambda words, text: 100 * n_repeat_words(words) > 50 * F.size(words)),
    Rule("symbols", lambda words, text: 100 * n_symbols(text) > 20 * F.size(words)),
    Rule("duplicate_lines", lambda words, text: 2 * n_dup_lines(text) > F.size(lines_of(text))),
    Rule("mean_word", lambda words, text: ~word_chars(words).between(2 * F.size(words), 20 * F.size(words))),
    Rule("no_letters", _share(lambda w: ~w.rlike(r"\p{L}"), 50)),
    Rule("shouting", _share(lambda w: w.rlike(r"^[^\p{Ll}]*\p{Lu}{2}[^\p{Ll}]*$"), 50)),
]
BASE_RULES = ("too_short", "repeats")


@dataclass(frozen=True)
class Estimate:
    """A rule's seconds on the sample, and the share it rejects of what the rules before it leave."""

    name: str
    seconds: float
    rejected: float


def _seconds(sample: DataFrame, rules: Sequence[Rule]) -> dict[str, float]:
    """What each rule adds to the time of splitting words, for one pass over ``sample``.

    Rows are repeated within a job until the splitting takes ``LEAST_SECONDS``; all conditions are
    timed in turns, ``RUNS`` times, and medians are taken. A rule that adds less than the spread of
    the splitting's own times counts as that spread.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def timed(condition: Callable[[Column, Column], Column], times: int) -> float:
        again = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(times))))
        asked = again.agg(F.count_if(let(words_of(text), lambda w: condition(w, text))))
        start = time.perf_counter()
        asked.collect()
        return time.perf_counter() - start

    nothing = lambda words, _: F.size(words) < 0
    timed(nothing, 1)  # not the compiler's time
    times = 1
    while times < 1024 and timed(nothing, times) < LEAST_SECONDS:
        times *= 2
    floors, found = [], {r.name: [] for r in rules}
    for _ in range(RUNS):
        floors.append(timed(nothing, times))
        for rule in rules:
            found[rule.name].append(timed(rule.rejects, times))
    spread = max(max(floors) - min(floors), 0.1 * median(floors))
    return {name: max(median(took) - median(floors), spread) / times for name, took in found.items()}


def ordered(
    rules: Sequence[str], seconds: dict[str, float], verdicts: dict[tuple[bool, ...], int]
) -> list[Estimate]:
    """Rules by rejections per second among what the rules placed before them leave.

    ``verdicts`` counts rows by what each rule, in the order of ``rules``, says of them. A rule passes
    one listed before it only if it is better by the factor ``CLEARLY``, so timings that differ by
    less than that between calls change nothing.
    """
    left, todo, plan = dict(verdicts), list(rules), []
    while todo:
        total = sum(left.values())
        rejected = {r: sum(n for v, n in left.items() if v[rules.index(r)]) / max(1, total) for r in todo}
        best = todo[0]
        for r in todo[1:]:
            if rejected[r] / seconds[r] > CLEARLY * rejected[best] / seconds[best]:
                best = r
        plan.append(Estimate(best, seconds[best], rejected[best]))
        todo.remove(best)
        left = {v: n for v, n in left.items() if not v[rules.index(best)]}
    return plan


def estimate(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    rows: int = SAMPLE_ROWS,
    seed: int = 7,
    placed: Sequence[Rule] = (),
) -> list[Estimate]:
    """The order for ``rules`` after those in ``placed``, by a random sample of ``docs``, best first.

    The sample is written once. At most ``2 ** len(rules)`` counts reach the driver. An empty table
    leaves the rules as they are.
    """
    total = docs.count()
    if not total:
        return [Estimate(r.name, 0.0, 0.0) for r in rules]
    drawn = docs.select("text").sample(fraction=min(1.0, rows / total), seed=seed)
    # The few rows drawn are moved together; the scan they come from keeps all its tasks.
    sample = publish(drawn.repartition(4), "quality-sample")
    text = F.coalesce(F.col("text"), F.lit(""))

    def judged(words: Column) -> Column:
        before = F.lit(False)
        for rule in placed:
            before = before | rule.rejects(words, text)
        return F.struct(before.alias("gone"), F.array(*[r.rejects(words, text) for r in rules]).alias("says"))

    said = sample.select(let(words_of(text), judged).alias("v")).where("NOT v.gone")
    verdicts = {tuple(r[0]): r[1] for r in said.groupBy("v.says").count().collect()}
    return ordered([r.name for r in rules], _seconds(sample, rules), verdicts)


def first_failure(words: Column, text: Column, rules: Sequence[Rule], plan: Sequence[Estimate]) -> Column:
    """The rule that rejects the text, in the planned order; null if none does. Later rules are not
    evaluated once one rejects."""
    by_name = {r.name: r for r in rules}
    verdict = F.when(F.lit(False), F.lit(""))
    for e in plan:
        if e.name in by_name:
            verdict = verdict.when(by_name[e.name].rejects(words, text), F.lit(e.name))
    return verdict


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES, plan: Sequence[Estimate] | None = None) -> DataFrame:
    """The rows of ``docs`` whose text no rule rejects, with all their columns. A null text counts
    as one without words and is rejected as too short; repeated rows are judged alike."""
    plan = estimate(docs, rules) if plan is None else plan
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.where(let(words_of(text), lambda w: first_failure(w, text, rules, plan).isNull()))


def report(docs: DataFrame, plan: Sequence[Estimate] | None = None) -> DataFrame:
    """Base statistics of every row and its verdict. The base rules are read off the statistics,
    which are wanted for every row; the cascade runs over the other rules for rows that pass them."""
    others = [r for r in RULES if r.name not in BASE_RULES]
    if plan is None:
        plan = estimate(docs, others, placed=[r for r in RULES if r.name in BASE_RULES])
    text = F.coalesce(F.col("text"), F.lit(""))

    def row(words: Column) -> Column:
        stats = F.struct(
            F.size(words).cast("long").alias("n_words"),
            word_chars(words).cast("long").alias("word_chars"),
            n_symbols(text).cast("long").alias("n_symbols"),
            n_dup_lines(text).cast("long").alias("n_dup_lines"),
            n_repeat_words(words).cast("long").alias("n_repeat_words"),
        )

        def judged(s: Column) -> Column:
            failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
            passed = F.when(failed, False).otherwise(first_failure(words, text, others, plan).isNull())
            return F.struct(s.alias("s"), failed.alias("base_failed"), passed.alias("kept"))

        return let(stats, judged)

    found = docs.select("doc_id", let(words_of(text), row).alias("r"))
    return found.select("doc_id", "r.s.*", "r.base_failed", "r.kept")

"""Where patterns match in a text, with built-in functions only and in time linear in the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefix sums are taken in blocks of this many numbers, so that n matches cost n * BLOCK additions
# at most (and (n / BLOCK) ** 2 for the blocks) instead of n ** 2.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def sums_before(numbers: Column) -> Column:
    """For each of the (int) numbers, the sum of those before it; empty for an empty array."""

    def starts(numbers: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int"))
        cut = lambda b: F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK))
        inside = lambda base, block: F.transform(
            block, lambda _, j: base + total(F.slice(block, F.lit(1), j))
        )
        return let(
            F.transform(blocks, lambda b: total(cut(b))),
            lambda sums: F.flatten(
                F.transform(
                    blocks,
                    lambda b: let(
                        F.struct(total(F.slice(sums, F.lit(1), b)).alias("base"), cut(b).alias("block")),
                        lambda s: inside(s["base"], s["block"]),
                    ),
                )
            ),
        )

    return let(numbers, lambda n: F.when(F.size(n) > 0, starts(n)).otherwise(F.array().cast("array<int>")))


MATCHES = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"


def matches(text: Column, pattern: str, gate: Column | None = None, around: int = 40) -> Column:
    """Leftmost non-overlapping matches of a Java ``pattern`` that never matches the empty string.

    One struct per match: ``start`` and ``end`` in code points, the text of the match, up to
    ``around`` code points before it (not reaching into the match before) and one after it. ``gate``
    is a cheap condition without which no match is possible. A null text has no matches.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def located(parts: Column) -> Column:
        gaps, hits = parts["gaps"], parts["hits"]
        steps = F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(gaps, i)))
        return let(
            sums_before(steps),
            lambda at: F.transform(
                hits,
                lambda h, i: let(
                    F.get(at, i) + F.length(F.get(gaps, i)),
                    lambda start: F.struct(
                        start.alias("start"),
                        (start + F.length(h)).alias("end"),
                        h.alias("hit"),
                        F.right(F.get(gaps, i), F.lit(around)).alias("before"),
                        F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"),
                    ),
                ),
            ),
        )

    none = F.array().cast(MATCHES)
    found = let(
        hits,
        lambda h: F.when(
            F.size(h) > 0,
            let(F.struct(F.split(text, pattern, -1).alias("gaps"), h.alias("hits")), located),
        ).otherwise(none),
    )
    possible = text.isNotNull() if gate is None else text.isNotNull() & gate
    return F.when(possible, found).otherwise(none)


def written(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of every span, by start, then kind as listed, then end, joined by commas.

    ``spans`` holds structs with ``start``, ``kind`` (number in ``kinds``) and ``end``."""
    names = F.array(*[F.lit(k) for k in kinds])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.array_join(
        F.transform(
            F.array_distinct(ordered),
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def counted(spans: str, kind: int, also: Callable[[Column], Column] | None = None) -> Column:
    """How many spans of a column of spans are of a kind."""
    wanted = lambda s: (s["kind"] == kind) & (F.lit(True) if also is None else also(s))
    return F.size(F.filter(spans, wanted)).cast("long")


def redacted(text: Column, spans: Column, marks: list[str]) -> Column:
    """The text with each span replaced by the mark of its kind; of overlapping spans the first
    starts the replacement and the furthest end closes it."""

    def cut(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
        names = F.array(*[F.lit(m) for m in marks])
        step = lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    a["parts"],
                    F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"])),
                ).alias("parts"),
            ),
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["parts"].alias("parts")))
        last = F.aggregate(spans, start, step)
        return let(last, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.when(F.size(spans) > 0, let(ordered, cut)).otherwise(text)

"""Licence notices in whole texts: exact phrases, and short notices with a few errors.

A notice that may hold ``k`` errors is split into ``k + 1`` pieces, of which an occurrence leaves at
least one intact. All pieces of all notices are searched at once in the text's words; where one
stands, the notice would start within ``k`` characters of a known place. Only there the ``regex``
library matches the notice with bounded errors, and tells where it stands and how many they are.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases whose words, standing in a row, name a licence.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# The wording licences publish for their notices, as lower-case words. What stands in
# braces tells licences apart.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("released under the {mit} license", "mit"),
    ("licensed under the {mit} license", "mit"),
    ("the {mit} license", "mit"),
    ("licensed under the {apache} license version 2 0", "apache"),
    ("under the {apache} license", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("gnu {general public} license", "gpl"),
    ("licensed under the {gnu general public} license version", "gpl"),
    ("redistribute it and or modify it under the terms of the gnu {general public} license", "gpl"),
    ("gnu {lesser general public} license", "lgpl"),
    ("gnu {affero general public} license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under the {bsd} license", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors", "bsd"),
    ("subject to the terms of the {mozilla} public license", "mpl"),
    ("under the {mozilla} public license version", "mpl"),
    ("under the terms of the {eclipse} public license", "epl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("distributed under the {boost software} license version 1 0", "bsl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under {cc by} 4 0", "cc-by"),
    ("licensed under {cc by sa} 4 0", "cc-by-sa"),
    ("licensed under {cc by nc} 4 0", "cc-by-nc"),
    ("licensed under {cc by nd} 4 0", "cc-by-nd"),
    ("licensed under a {creative commons attribution} 4 0 international license", "cc-by"),
    ("licensed under a {creative commons attribution sharealike} 4 0 international license", "cc-by-sa"),
    ("licensed under a {creative commons attribution noncommercial} 4 0 international license", "cc-by-nc"),
    ("has waived all copyright and related or neighboring rights", "cc0"),
)

# Characters per error, in the words of a name (so short ones must be exact) and in what is around it.
PER_ERROR, PER_NAME_ERROR = 8, 6
# Errors in one part of a notice at most: long notices hold them more sparsely.
MOST_ERRORS = 3

# ASCII that is no letter or digit separates words; A-Z are lowered.
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

SCANNED = (
    "doc_id long, n_words long, base array<struct<label:string,word:long>>, "
    "found array<struct<label:string,start:long,end:long,errors:int,score:double,text:string>>"
)


class Notice(NamedTuple):
    """``words`` without braces, the ``errors`` allowed in all, and the ``pattern`` with the errors
    each of its parts may hold."""

    label: str
    words: str
    errors: int
    pattern: object


class Found(NamedTuple):
    """A notice in a text: words ``start`` to ``end`` (exclusive, from 0)."""

    label: str
    start: int
    end: int
    errors: int
    score: float
    text: str


def notice(written: str, label: str) -> Notice:
    import regex

    parts, errors = [], 0
    for i, part in enumerate(written.replace("}", "{").split("{")):
        if part:
            k = sum(len(w) // PER_NAME_ERROR for w in part.split()) if i % 2 else min(len(part) // PER_ERROR, MOST_ERRORS)
            errors += k
            parts.append(f"(?:{regex.escape(part, special_only=True)}){{e<={k}}}" if k else regex.escape(part, special_only=True))
    pattern = regex.compile(f"(?b)(?<![^ ])(?:{''.join(parts)})(?![^ ])")
    return Notice(label, written.replace("{", "").replace("}", ""), errors, pattern)


def pieces(words: str, errors: int) -> list[tuple[int, str]]:
    """``words`` in ``errors + 1`` parts as equal as can be, with where each starts."""
    edges = [len(words) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, words[a:b]) for a, b in zip(edges, edges[1:])]


class Searcher:
    """Exact phrases and fuzzy notices over one text at a time."""

    def __init__(self, phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]]):
        import ahocorasick

        self.phrases = [(f" {p} ", label) for p, label in phrases]
        self.notices = [notice(written, label) for written, label in notices]
        seeds = defaultdict(list)
        for i, n in enumerate(self.notices):
            for at, piece in pieces(n.words, n.errors):
                seeds[piece].append((i, at))
        self.machine = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.machine.add_word(piece, (len(piece), places))
        self.empty = not seeds
        if seeds:
            self.machine.make_automaton()

    def base(self, line: str) -> list[tuple[str, int]]:
        """``(label, first word)`` of every place of a phrase; ``line`` has words between single
        spaces, and a space at both ends."""
        found = []
        for phrase, label in self.phrases:
            at, word, counted = line.find(phrase), 0, 0
            while at >= 0:
                word += line.count(" ", counted, at)
                counted = at
                found.append((label, word))
                at = line.find(phrase, at + 1)
        return found

    def starts(self, line: str) -> dict[int, list[int]]:
        """Where each notice would start, by the intact pieces in ``line``."""
        found = defaultdict(set)
        if not self.empty:
            for end, (length, places) in self.machine.iter(line):
                for i, at in places:
                    found[i].add(end + 1 - length - at)
        return {i: sorted(s) for i, s in found.items()}

    def matched(self, line: str, i: int, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """``(errors, start, end)`` of disjoint matches of notice ``i`` between two places, best first."""
        _, words, k, pattern = self.notices[i]
        ranges = [(max(lo, 0), min(hi, len(line)))]
        while ranges:
            lo, hi = ranges.pop()
            if hi - lo < len(words) - k:
                continue
            match = pattern.search(line, lo, hi)
            # The end of a range is no end of a word.
            if match and line[match.end() : match.end() + 1] in (" ", ""):
                yield sum(match.fuzzy_counts), match.start(), match.end()
                ranges += [(lo, match.start()), (match.end(), hi)]

    def fuzzy(self, line: str) -> list[Found]:
        """The notices in ``line``, of those of a label that overlap the one with the least share of
        errors. Starts that may belong to one match are searched together."""
        matches = defaultdict(set)
        for i, starts in self.starts(line).items():
            label, words, k, _ = self.notices[i]
            at = 0
            while at < len(starts):
                first = last = starts[at]
                while at < len(starts) and starts[at] - first <= 2 * k + 1:
                    last = starts[at]
                    at += 1
                for errors, start, end in self.matched(line, i, first - k - 1, last + len(words) + 2 * k + 1):
                    matches[label].add((errors / len(words), start, end, errors))
        kept = []
        for label, spans in matches.items():
            taken: list[tuple[int, int]] = []  # disjoint and sorted
            for share, start, end, errors in sorted(spans):
                j = bisect(taken, (start, end))
                if (j == 0 or taken[j - 1][1] <= start) and (j == len(taken) or end <= taken[j][0]):
                    taken.insert(j, (start, end))
                    kept.append((start, label, end, errors, share))
        out, word, counted = [], -1, 0
        for start, label, end, errors, share in sorted(kept):
            word += line.count(" ", counted, start + 1)
            counted = start + 1
            text = line[start:end].strip()
            first = word + (line[start] == " ")
            out.append(Found(label, first, first + text.count(" ") + 1, errors, 1.0 - share, text))
        return out

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int]], list[Found]]:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
        if not words:
            return 0, [], []
        line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
        return len(words), self.base(line), self.fuzzy(line)


@lru_cache(maxsize=4)
def searcher(phrases: tuple, notices: tuple) -> Searcher:
    """One per process for the same lists."""
    return Searcher(phrases, notices)


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """``(doc_id, n_words, base, found)`` for every row of ``docs``, from its whole text.

    ``base`` lists every place of a phrase (label, first word), ``found`` the notices with at most one
    error per eight characters (six within each word of a name; three in a row of other words): label, words ``start`` to ``end`` (exclusive),
    errors, score (1 less the share of errors) and the words found. Null texts count as empty and
    have no words; repeated rows are scanned each; other columns are not read. A text is split at
    ASCII that is no letter or digit, so notices may be set with any signs and line breaks.
    """
    phrases, notices = tuple(phrases), tuple(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = searcher(phrases, notices)
        for batch in batches:
            rows = [one.scan(t.as_py()) for t in batch.column(1)]
            base = [[{"label": label, "word": w} for label, w in r[1]] for r in rows]
            found = [[f._asdict() for f in r[2]] for r in rows]
            columns = [
                batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array(base, _BASE), pa.array(found, _FOUND)
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "base", "found"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCANNED)


_BASE = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_FOUND = pa.list_(
    pa.struct(
        [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int32()), ("score", pa.float64()),
         ("text", pa.string())]
    )
)


def report(scanned: DataFrame) -> DataFrame:
    """``scan``'s rows in short: counts, first and last place of a phrase, labels and a score (1 if a
    phrase was found, else the best notice's, else 0)."""

    def listed(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    base, found = F.col("base"), F.col("found")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["word"]).alias("first_word"),
        F.array_max(base["word"]).alias("last_word"),
        listed(base["label"]).alias("base_labels"),
        listed(F.concat(base["label"], found["label"])).alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(F.array_max(found["score"]), F.lit(0.0))).alias("score"),
        found.alias("spans"),
    )

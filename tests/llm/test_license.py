"""Licence notices: exact phrases by their definition, fuzzy ones against matching everywhere."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from tagwright.llm import license_scan
from tagwright.llm.queries import op13_license_scan

ONE = license_scan.searcher(license_scan.PHRASES, license_scan.NOTICES)
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def spoiled(rnd, text, edits):
    for _ in range(edits):
        i = rnd.randrange(len(text))
        text = rnd.choice([text[:i] + text[i + 1 :], text[:i] + rnd.choice(LETTERS + " ") + text[i:], text[:i] + rnd.choice(LETTERS) + text[i + 1 :]])
    return text


def written(rnd, text):
    """The words with other signs, cases and line breaks between them."""
    return "".join(rnd.choice([" ", "\n", " - ", ", ", "_", "\t"]) if c == " " else rnd.choice([c, c.upper()]) for c in text)


@pytest.mark.parametrize("seed", range(8))
def test_no_match_of_any_pattern_is_lost(seed):
    """Labels found are those of patterns that match somewhere, whatever the pieces are."""
    rnd = random.Random(seed)
    some = "the public domain of general software is a work under this gnu and mit use license file".split()
    for _ in range(25):
        noise = lambda: " ".join(rnd.choices(some, k=rnd.randrange(0, 8)))
        parts = [spoiled(rnd, rnd.choice(ONE.notices).words, rnd.randrange(0, 6)) for _ in range(rnd.randrange(0, 4))]
        text = written(rnd, " ".join(x for p in parts for x in (noise(), p, noise()) if x))
        words, places = brute.licensed(text)
        line = f" {' '.join(words)} "
        want = {n.label for n in ONE.notices if words and n.pattern.search(line)}
        n, base, found = ONE.scan(text)
        assert n == len(words) and sorted(base) == sorted(places)
        assert {f.label for f in found} == want
        for f in found:
            assert " ".join(words[f.start : f.end]) == f.text and 0 <= f.score <= 1


def test_spans_of_typing_errors():
    cases = {
        "Relased under the MIT-Licence!": [("mit", 0, 5, 2)],
        "see: GNU Genral Public Licens v3, and\nLicenced under the apache licence": [("gpl", 1, 5, 2), ("apache", 8, 12, 1)],
        "Permission is hereby granted, fre of charge, to any persn obtaining a copy": [("mit", 0, 13, 2)],
        "Licensed under CC BY-NC 4.0 / licensed under cc by sa 4.0": [("cc-by-nc", 0, 7, 0), ("cc-by-sa", 7, 14, 0)],
        "released under the BSE license; licensed under the bsd licence": [("bsd", 5, 10, 1)],
        "submit license, the general public, a permit. granted free of charge": [],
    }
    for text, want in cases.items():
        assert [(f.label, f.start, f.end, f.errors) for f in ONE.scan(text)[2]] == want, text


def test_query(spark, docs, texts, tmp_path):
    more = [
        (-60, "MIT License apache\n\nLICENSE general public license mit license mit license" + " word" * 250_000 + " the MIT licence"),
        (-61, "permission is hereby granted free of charg " * 300),
        (-62, "é́mit license mité license mit\x7flicense 本 apache license"),
        (-63, "released under teh mit licence"),
    ]
    every = docs.unionByName(spark.createDataFrame([*more, more[2]], "doc_id long, text string"), allowMissingColumns=True)
    folder = str(tmp_path / "tables")
    every.withColumns({c: F.lit(7) for c in ("found", "base", "n_words", "labels")}).write.parquet(f"{folder}/documents.parquet")
    rows = op13_license_scan(spark, folder).collect()
    texts = texts | dict(more)
    assert sorted(r.doc_id for r in rows) == sorted([*texts, -62])
    for r in rows:
        words, places = brute.licensed(texts[r.doc_id])
        at = [w for _, w in places]
        line = f" {' '.join(words)} "
        labels = {label for label, _ in places} | {n.label for n in ONE.notices if words and n.pattern.search(line)}
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(at), max(at)) if at else (None, None))
        assert r.base_labels == ",".join(sorted({label for label, _ in places}))
        assert r.labels == ",".join(sorted(labels))
        assert (r.score == 1.0) if at else (r.score > 0.8) if labels else (r.score == 0.0)


def test_empty(spark, empty):
    assert license_scan.report(license_scan.scan(empty)).count() == 0
    assert license_scan.scan(empty, phrases=(), notices=()).count() == 0
    assert license_scan.Searcher((), ()).scan("mit license") == (2, [], [])

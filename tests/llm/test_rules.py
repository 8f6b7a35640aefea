"""Personal data, secrets and quality rules."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tagwright.llm import pii, quality, secret_scan


def test_personal_data(docs, texts):
    detected = pii.detect(docs.drop("candidates"))
    got = {r.doc_id: r for r in pii.report(detected, pii.fit(detected)).collect()}
    assert set(got) == set(texts)
    for key, text in texts.items():
        want, row = brute.personal(text), got[key]
        assert row.base_sha256 == brute.digest(want), key
        counts = [sum(s[3] == k for s in want) for k in pii.BASE]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts
        assert set(brute.written(want).split(",")) <= set(row.spans.split(","))


def test_labelers_find_more_than_the_base(spark):
    rows = [(i, f"Dear Mr. Jones, call 555-123-4{i:03d} about ssn 123-45-6{i:03d} please") for i in range(100, 160)]
    rows += [(i, f"order part 4111-22-3{i:03d} serial number 123-45-6{i:03d}") for i in range(200, 210)]
    detected = pii.detect(spark.createDataFrame(rows, "doc_id long, text string"))
    model = pii.fit(detected)
    got = {r.doc_id: r.spans for r in pii.report(detected, model).collect()}
    assert "name:5:14" in got[100] and "local_phone:21:33" in got[100] and "national_id:44:55" in got[100]
    assert all(0 <= r <= 1 for r in model.reliabilities)


def test_the_classifier_sees_the_span_and_the_word_before_it(spark):
    # Even ones come after "order", begin like no issuer's and are not grouped in fours.
    number = [f"4111 1111 1111 {i}" if i % 2 else f"99111 111 1111 {i}" for i in range(1000, 1200)]
    rows = [(i, f"{'my card' if i % 2 else 'your order'} {n} thanks") for i, n in enumerate(number)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    detected = pii.detect(frame)
    model = pii.fit(detected)
    got = {r.doc_id: r.spans for r in pii.report(detected, model).collect()}
    plain = {i for i, n in enumerate(number) if not brute.luhn(n.replace(" ", ""))}
    assert {i for i in plain if got[i]} == {i for i in plain if i % 2}
    # The word decides, not the votes: the same numbers after the other word are judged by it.
    turned = [(i, f"{'your order' if i % 2 else 'my card'} {n} thanks") for i, n in enumerate(number)]
    again = pii.report(pii.detect(spark.createDataFrame(turned, "doc_id long, text string")), model)
    assert {r.doc_id for r in again.collect() if r.doc_id in plain and r.spans} == {i for i in plain if i % 2 == 0}


def test_reliabilities_are_learnt_per_kind():
    # For kind 0 the first labeler is right, for kind 1 it says the opposite of the three others.
    patterns = [(0, (1, 1, 1, 1), 50), (0, (-1, -1, -1, -1), 50), (1, (-1, 1, 1, 1), 50), (1, (1, -1, -1, -1), 50)]
    beliefs = pii.reliabilities(patterns)
    assert beliefs[0, (1, 1, 1, 1)] > 0.9 > 0.1 > beliefs[0, (-1, -1, -1, -1)]
    assert beliefs[1, (-1, 1, 1, 1)] > 0.9 > 0.1 > beliefs[1, (1, -1, -1, -1)]
    assert pii.reliabilities([]) == {}


def test_logistic_weights_are_an_optimum():
    rng = np.random.default_rng(3)
    on = np.stack([rng.integers(0, 2, 40), rng.integers(2, 5, 40)], axis=1)
    n, target = rng.integers(1, 9, 40), rng.random(40)

    def value(w):
        p = 1 / (1 + np.exp(-w[on].sum(axis=1)))
        whole = np.array([n[on[:, 0] == g].sum() for g in on[:, 0]])
        return (n / whole * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum() - 0.05 * (w**2).sum()

    best = pii.logistic(on, n, target, 5, penalty=0.1)
    assert all(value(best) >= value(best + d) for d in 1e-3 * rng.normal(size=(200, 5)))


def test_other_gazetteers(spark):
    frame = spark.createDataFrame([(1, "Signed by Fru Nguyen today"), (2, "Mr Jones")], "doc_id long, text string")
    found = pii.detect(frame, lists=pii.Gazetteers(titles="Fru"))
    assert [len(r.candidates) for r in found.orderBy("doc_id").collect()] == [1, 0]


def test_redaction_keeps_everything_else(docs, texts):
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.select("doc_id", "text", "n_chars").collect()}
    assert got[-1].text is None
    assert got[-6].text == "<EMAIL> " * 700 and got[-6].n_chars == len(got[-6].text)
    clean = [k for k, t in texts.items() if k >= 0 and not brute.personal(t)]
    assert all(got[k].text == texts[k] for k in clean)
    dirty = [k for k, t in texts.items() if k >= 0 and brute.personal(t)]
    assert dirty and not any(brute.personal(got[k].text) for k in dirty)


def test_secrets(docs, texts):
    got = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    assert set(got) == set(texts)
    for key, text in texts.items():
        want, row = brute.secrets(text), got[key]
        assert row.base_sha256 == brute.digest(want), key
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(s[3] == k for s in want) for k in secret_scan.BASE]


@pytest.mark.parametrize("string", ["0123456789abcdef0123", "aaaaaaaaaaaaaaaaaaaaaaaaab", "Zm9vYmFyYmF6cXV4QUJDMTIzNDU2Nzg5MA==", "short"])
def test_peak_entropy_equals_counting_each_window(spark, string):
    from collections import Counter
    from math import log2

    w, alphabet = secret_scan.WINDOW, secret_scan.CLASSES[-1][0]
    windows = [Counter(string[i : i + w]) for i in range(len(string) - w + 1)]
    want = max([0, *(-sum(n / w * log2(n / w) for n in c.values()) for c in windows)])
    got = spark.range(1).select(secret_scan.peak_entropy(F.lit(string), alphabet)).first()[0]
    assert got == pytest.approx(want)


def test_entropy_and_allow_list(spark):
    rows = [
        (1, "key wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY end"),
        (2, "id 550e8400-e29b-41d4-a716-446655440000 is a uuid"),
        (3, "words donaudampfschifffahrtsgesellschaft some-long-name-with-words"),
        (4, "numbers 12345678901234567890123"),
    ]
    got = {r.doc_id: r.spans for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "entropy:4:44", 2: "", 3: "", 4: ""}


def test_rows_of_one_sign_hide_no_secret(spark):
    key = "Xk3vQ9zLw7RtB2nYp5HsJ8dFgM4c"
    rows = [
        ("b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQAAAAAAAAABAAAAMwAAAAtzc2gtZW", True),
        ("=" * 8 + key, True),
        (key + "_" * 40, True),
        ("-" * 10 + "0F1E2D3C4B5A69788796" + "A5B4C3D2E1F0" + "-" * 10, True),
        ("sha256-" + key * 5, True),
        ("sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", False),
        ("=" * 40, False),
        ("-" * 10 + "some-long-name-with-words" + "-" * 10, False),
        ("=" * 8 + "550e8400-e29b-41d4-a716-446655440000" + "=" * 8, False),
    ]
    frame = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: "entropy" in r.spans for r in secret_scan.scan(frame).collect()}
    assert got == {i: want for i, (_, want) in enumerate(rows)}


def test_quality(docs, texts):
    plan = quality.estimate(docs)
    assert {e.name for e in plan} == {r.name for r in quality.RULES}
    got = {r.doc_id: r for r in quality.report(docs, plan).collect()}
    for key, text in texts.items():
        r = got[key]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(text), key
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in quality.keep(docs, plan=plan).select("doc_id").collect()}
    assert kept == {k for k, r in got.items() if r.kept}
    backwards = {r.doc_id for r in quality.keep(docs, plan=plan[::-1]).select("doc_id").collect()}
    assert backwards == kept  # the order changes the cost only


def test_rules_are_ordered_by_what_is_left_and_by_clear_differences():
    names, verdicts = ["a", "b", "c"], {(True, True, False): 50, (False, False, True): 10, (False,) * 3: 40}
    # All that b rejects is gone after a, so c is next.
    plan = quality.ordered(names, {"a": 1.0, "b": 1.1, "c": 5.0}, verdicts)
    assert [(e.name, e.rejected) for e in plan] == [("a", 0.5), ("c", 0.2), ("b", 0.0)]
    # A little quicker changes nothing, clearly quicker does.
    assert quality.ordered(names, {"a": 1.0, "b": 0.8, "c": 5.0}, verdicts)[0].name == "a"
    assert quality.ordered(names, {"a": 1.0, "b": 0.5, "c": 5.0}, verdicts)[0].name == "b"
    assert [e.name for e in quality.ordered(names, dict.fromkeys(names, 1.0), {})] == names


def test_rules_have_one_order_in_three_calls(docs):
    placed = [r for r in quality.RULES if r.name in quality.BASE_RULES]
    others = [r for r in quality.RULES if r not in placed]
    orders = {tuple(e.name for e in quality.estimate(docs, others, placed=placed)) for _ in range(3)}
    assert len(orders) == 1


def test_quality_agrees_with_labels(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    kept = quality.report(docs).join(labels, "doc_id")
    wrong = kept.where("(quality = 1 AND NOT kept AND n_words >= 50) OR (quality = 0 AND kept)").count()
    assert wrong == 0


def test_empty_tables(empty):
    detected = pii.detect(empty.drop("candidates"))
    assert pii.report(detected, pii.fit(detected)).count() == 0
    assert secret_scan.scan(empty).count() == 0
    assert quality.report(empty).count() == 0
    assert pii.redact(empty).count() == 0

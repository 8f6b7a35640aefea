"""Near-duplicates, top-k, toxicity and pages."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tagwright.llm import html_text, simhash, topk, toxicity
from tagwright.llm.components import components

DIR = "/root/testdata/sf0.001"


def test_near_duplicates(docs, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {k: brute.fingerprint(t) for k, t in texts.items()}
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{p:016x}" for k, p in prints.items()}
    want = brute.classes(prints)
    assert {k: r.component_id for k, r in got.items()} == want
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(want.values()))


def test_masks_cover_every_pair_within_the_radius():
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks()]
    rng = np.random.default_rng(1)
    for _ in range(2000):
        differing = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not differing & m for m in masks)


@pytest.mark.parametrize("block", [16, 2048])
def test_large_buckets_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", 4)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    center, prints = int(rng.integers(1 << 62)), set()
    for _ in range(150):
        prints.add(center ^ sum(1 << int(b) for b in rng.choice(62, int(rng.integers(1, 8)), replace=False)))
    frame = spark.createDataFrame([(p,) for p in sorted(prints)], "fingerprint long")
    found = components(simhash.links(frame), "a", "b").collect()
    root = {p: p for p in prints} | {r.node: r.root for r in found}
    want = brute.classes({p: p for p in prints})
    assert root == want


def test_large_buckets_count_the_upper_bits(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", 4)
    rng = np.random.default_rng(4)
    low = [sum(1 << int(b) for b in rng.choice(60, n % 4, replace=False)) for n in range(80)]
    prints = {1 << 30 ^ upper << 60 ^ x for upper in (0b0000, 0b1111) for x in low}  # two families 4 bits apart
    signed = {p - (p >> 63 << 64): p for p in prints}
    assert min(signed) < 0 < max(signed)
    frame = spark.createDataFrame([(p,) for p in sorted(signed)], "fingerprint long")
    found = components(simhash.links(frame), "a", "b").collect()
    assert {p: p for p in signed} | {r.node: r.root for r in found} == brute.classes(signed)


@pytest.mark.parametrize("bits", [(63, 5), (63, 62, 61), (60, 61, 62, 63), (63,), (63, 0, 1, 2)])
def test_forest_counts_all_64_bits(bits):
    for at in (5, -(1 << 63), -1):
        other = int(np.int64(at) ^ np.array(sum(1 << b for b in bits), np.uint64).view(np.int64))
        edges = simhash._forest(np.array([at, other]), 3)
        assert {frozenset(e) for e in edges} == ({frozenset((at, other))} if len(bits) <= 3 else set())


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1000 + i) for i in range(1, 200)]
    edges = spark.createDataFrame([*chain, *hub, (5000, 5000), (7000, 7001), (7001, 7000)], "a long, b long")
    got = {r.node: r.root for r in components(edges, "a", "b").collect()}
    want = {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 200)} | {7001: 7000}
    assert got == want
    assert components(edges.where("false"), "a", "b").count() == 0


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "x y z"), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(frame)
    assert got.count() == 5
    assert sorted(str(r.doc_id) for r in simhash.deduplicate(frame).collect()) == ["1", "3", "None"]


def test_top_k(spark):
    vectors = spark.read.parquet(f"{DIR}/embeddings.parquet")
    rows = {r.vec_id: np.floor(256 * np.array(r.embedding, np.float64)).astype(np.int64) for r in vectors.collect()}
    odd = [(9000, None), (9001, [1.0, None]), (9002, [float("nan")]), (9003, [float("inf")]), (None, [1.0])]
    both = vectors.select("vec_id", F.col("embedding").cast("array<double>")).unionByName(
        spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    )
    v = topk.quantised(both.withColumn("v", F.lit(1)).withColumn("part", F.lit(1)))
    got = {tuple(r) for r in topk.top_k(v.where("vec_id % 50 = 0"), v).collect()}
    assert got == brute.top(rows)


@pytest.mark.parametrize("scale", [1, 10**5, 10**8])
def test_pruned_shards_and_ties(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "SHARD_VECTORS", 16)
    monkeypatch.setattr(topk, "PROBE", 2)
    rng = np.random.default_rng(5)
    rows = {i: rng.integers(-3, 4, 12) * scale for i in range(300)}
    frame = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in rows.items()], "vec_id long, v array<long>")
    got = {tuple(r) for r in topk.top_k(frame.where("vec_id % 50 = 0"), frame).collect()}
    assert got == brute.top(rows)
    # Groups that hold several shards, and blocks of few queries.
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    assert {tuple(r) for r in topk.top_k(frame.where("vec_id % 50 = 0"), frame.repartition(20)).collect()} == got
    assert topk.top_k(frame.where("vec_id = 0"), frame.where("vec_id < 3")).count() == 2
    assert topk.top_k(frame.where("false"), frame.where("false")).count() == 0


def test_candidates_of_one_id_count_each_and_queries_once(spark):
    rows = [(1, [3, 1]), (1, [2, 2]), (1, [2, 2]), (2, [1, 0]), (3, [5, 5])]
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = sorted(tuple(r) for r in topk.top_k(frame.where("vec_id IN (1, 3)"), frame, k=4).collect())
    assert got == [(1, 1, 3, 20), (1, 2, 2, 2), (3, 1, 1, 20), (3, 2, 1, 20), (3, 3, 1, 20), (3, 4, 2, 5)]


def test_a_shard_is_shuffled_once_however_many_queries(spark):
    frame = spark.range(2000).selectExpr("id AS vec_id", "array(id, id % 7) AS v")
    plan = topk.top_k(frame.where("vec_id % 2 = 0"), frame)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 3 > 0"))
    counts = {}
    rows = toxicity.score(docs, model).withColumnRenamed("toxic", "says").join(labels.where("doc_id % 3 = 0"), "doc_id")
    for r in rows.groupBy("toxic", "says").count().collect():
        counts[(r["toxic"], r["says"])] = r["count"]
    caught, missed = counts.get((1, True), 0), counts.get((1, False), 0)
    assert caught / (caught + missed) > 0.85
    assert counts.get((0, True), 0) < 0.01 * counts[(0, False)]
    assert list(model.thresholds) == sorted(model.thresholds)


def test_toxicity_of_odd_texts(spark, docs, empty):
    labels = spark.createDataFrame([(-1, 1), (-2, 0), (None, 1), (99999, 1), (-3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and not any(r.toxic for r in rows)
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_toxicity_fits_on_one_row_of_each_document(spark):
    rows = [(i, ("vile " if i % 2 else "kind ") + "common words") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    model = toxicity.fit(frame(rows), labels)
    assert "vile" in model.features
    assert toxicity.fit(frame([*rows, *[(0, "kind common words")] * 500]), labels) == model


PAGE = (
    "<html><body><header>Site</header><div class=menu>m</div><main><article id=x class='post-{n}'><header><h1>T &amp; {n}</h1>"
    "</header><p>One<br>two &nbsp; three<p>four <a href='a>b'>link</a><div class='ad'>buy</div><p class='share-bar'>share</p>"
    "<ul><li>i1<li>i2</ul><section id=comments><p>c</p></section><script>x<p>y</script></article></main>"
    "<aside>side</aside><form>f</form><footer>z"
)


def test_pages(spark):
    pages = [(n, f"https://a.example.com/{n}", PAGE.format(n=n)) for n in range(5)]
    pages += [(10, None, "<p>alone"), (11, "https://a.example.com/", None), (12, "", ""), (12, "", "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("winner", F.lit(1))
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(frame).collect())
    text = lambda n: f"T & {n}\nOne two three\nfour link\ni1\ni2"
    want = [(n, text(n), len(text(n))) for n in range(5)] + [(10, "alone", 5), (11, "", 0), (12, "", 0), (12, "", 0)]
    assert got == want
    assert html_text.extract(frame.where("false")).count() == 0


def test_host_consensus_overrules_a_page(spark):
    good = "<body><div class='story s-{0}'><p>{1}</p><p>{1}</p></div><div class='links-{0}'>{2}</div></body>"
    words = "plain words of a story " * 6
    pages = [(n, "http://b.example/", good.format(n, words, "<p>short teaser")) for n in range(6)]
    pages.append((9, "http://b.example/", good.format(9, "brief story", "<p>" + "long teaser text " * 30)))
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[9] == "brief story\nbrief story"


@pytest.mark.parametrize(
    "page",
    [
        "<body class='single no-sidebar'>{}</body>",
        "<body class='has-sidebar'><div id=page class='with-sidebar'>{}</div></body>",
        "<body><main class='search-results'>{}</main></body>",
        "<body><article class='post related-posts-off'>{}</article></body>",
        "<body><div class=widget>{}</div></body>",
        "<body><form id=form1>{}</form></body>",
        "<body><nav>{}</nav></body>",
    ],
)
def test_names_of_the_page_do_not_mark_it(page):
    inner = "<p>" + "plain words " * 20 + "</p><div class=sidebar>side</div><p class='share-bar'>share</p>"
    found = html_text.blocks(page.format(inner))
    text = html_text.text_below(found, html_text.best_path(found)[0])
    assert text.startswith("plain words") and ("<nav>" in page or "\n" not in text)


@pytest.mark.parametrize(
    "page",
    [
        "<body><div class=lead>{0}</div><div class=body>{1}</div>",
        "<body><div class=wrapper><h1>Head</h1><div class=body>{0}{1}</div></div><div class=x><p>tiny</p></div>",
        "<body><div class=content><section class=intro><div>{0}</div></section><section class=more><div>{1}</div></section></div>",
        "<body><div class=list><article class=a>{0}</article><article class=b>{1}</article></div><div><p>tiny</p></div>",
    ],
)
def test_no_sibling_of_the_largest_container_is_lost(page):
    found = html_text.blocks(page.format("<p>" + "lead " * 60, "<p>" + "body " * 400))
    text = html_text.text_below(found, html_text.best_path(found)[0])
    assert "lead" in text and "body" in text and "tiny" not in text and ("Head" in text) == ("Head" in page)


def test_templates_and_one_long_page_of_a_host(spark):
    a = "<body><div class=a><p>" + "first template " * 30 + "</p></div><div class=c><p>teaser</p></div>"
    b = "<body><div class=a><p>a caption</p></div><div class=b><p>" + "second template " * 50 + "</p></div>"
    c = "<body><div class=c><p>" + "odd " * 30_000 + "</p></div>"
    pages = [(n, "http://c.example/", a if n < 6 else b if n < 8 else c) for n in range(9)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text[:6] for r in html_text.extract(frame).collect()}
    assert got == {n: "first " if n < 6 else "second" if n < 8 else "odd od" for n in range(9)}


def test_pages_of_the_table(spark):
    import html
    import re

    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = re.sub("<[^>]*>", "", re.sub(r"</?(?:p|h1)>", "\x01", body).replace("<br>", " ")).split("\x01")
        assert got[r.page_id] == "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)

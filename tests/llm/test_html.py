"""Main text: nothing of an article is lost, what is not of it goes, and any page ends in time."""

import time

import pytest

from tagwright.llm import html_text

STORY = "<p>" + "A sentence of the story. " * 27 + "</p>"


def alone(html):
    return html_text.page_text(html_text.blocks(html), None, None, None)


@pytest.mark.parametrize(
    "page,text",
    [
        ("<div class=wrap><div class=lead><p>{}</p></div><div class=story>{}</div></div>", "Fifty characters of a lead that must not be lost."),
        ("<div class=story>{1}</div><div class=end><p>{0}</p></div>", "The last paragraph, outside."),
        ("<div class=story>{1}</div><div class=a><div class=b><p>{0}</p></div></div>", "Deep in another branch."),
        ("<div class=story>{1}</div><p>{0}</p>", "Finis."),
        ("<article><div class=story>{1}</div><div class=x><p>{0}</p></div></article>", "Within the article."),
        ("<div class=story>{1}<div class='w-1/2'><p>{0}</p></div></div>", "A slash in a class is no path."),
    ],
)
def test_short_parts_of_an_article_stay(page, text):
    got = alone("<body>" + page.format(text, STORY))
    assert text in got and "A sentence of the story." in got


MARKED = (
    "reader-comments user-comments article-comments comments-title comment-body related-articles cookie-law-info global-nav "
    "page-footer google-ad social-media sidebarLeft mainMenu cookieConsent share_bar siteFooter adBox"
).split()
PLAIN = "no-sidebar has-sidebar with-sidebar without-ads related-posts-off comment-free adverb lead menuette w-1/2".split()


@pytest.mark.parametrize("name", MARKED + PLAIN)
@pytest.mark.parametrize("outer", ["article", "div"])
def test_names(name, outer):
    inner = f"<div class='{name}'><p>Some words that a name decides on.</p></div>"
    got = alone(f"<body><{outer}>{STORY}{inner}</{outer}>")
    assert ("a name decides" in got) == (name in PLAIN)


def test_tags_in_odd_quotes():
    assert alone("<p>a <a href='x>y'>b</a> c <i title=\"p > q\">d</i> e. f < g and h > i") == "a b c d e. f < g and h > i"
    assert alone("<p>it's <b class=x'>so</b>, \"they\" said: <q cite=\"u>v</q> end here now.") == "it's so, \"they\" said: v end here now."


@pytest.mark.parametrize(
    "part,size",
    [
        ("<a '", 8_000_000), ("<a b=\">\" ", 4_000_000), ("<a href=\"x ", 4_000_000), ("<div>", 1_500_000), ("< ", 2_000_000),
        ("<div class=sidebar>t t t t", 2_000_000), ("<div class=x><p class=ad>t.", 2_000_000), ("</section>", 2_000_000), ("<!-- ", 4_000_000),
    ],
)
def test_hostile_pages_take_linear_time(part, size):
    start = time.time()
    alone("<div>" * 20_000 + part * (size // len(part)) + "</section>" * 20_000)
    assert time.time() - start < 20


def test_depth_changes_nothing():
    deep = "<div class=a>" * 5_000
    side = "<div class=sidebar><p>Of the sidebar, deep.</p></div>"
    assert alone(f"<body>{deep}<div class=story>{STORY}</div><div class=more><p>More of the story.</p></div>{side}").endswith("More of the story.")
    two = f"<body>{deep}<div class=l><a href=x>{'link ' * 200}</a></div><div class=story>{STORY}</div>"
    assert "link" not in alone(two) and "story" in alone(two)


def extracted(spark, pages):
    frame = spark.createDataFrame([(n, "http://h.example/", p) for n, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_text.extract(frame).collect()}


def test_what_a_host_repeats_beside_its_articles_goes(spark):
    page = "<body><div class=top>Welcome to our page of stories.</div><div class=story><p>{0}</p></div><div class=end>{1}</div><div class=foot>All rights are ours.</div>"
    pages = [page.format(f"Story number {w} of this host. " * 20, f"It ended {w}ly.") for w in "one two three four five".split()]
    got = extracted(spark, pages)
    for n, w in enumerate("one two three four five".split()):
        assert got[n].startswith(f"Story number {w}") and got[n].endswith(f"It ended {w}ly.") and "Welcome" not in got[n] and "rights" not in got[n]


def test_copies_of_a_page_prove_nothing(spark):
    page = f"<body><div class=lead><p>The lead of the story, in short.</p></div><div class=story>{STORY}</div>"
    assert all(t.startswith("The lead") for t in extracted(spark, [page] * 6).values())


def test_places_without_prose_stay_out(spark):
    page = "<body><div class=story><p>{}</p></div><div class=tags>{}</div>"
    pages = [page.format(f"Story number {i} of this host. " * 20, "one two") for i in range(6)]
    pages.append(page.format("Another story of this host. " * 20, "here for once a sentence of tags."))
    assert "tags" not in extracted(spark, pages)[6]

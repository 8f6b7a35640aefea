"""Main text of web pages by host consensus.

Every page scores its containers and votes for one, named by the tags and generalised classes on the
way to it. Votes are summed per host in Spark; then each page is read again and gives the text below
its host's winning path (its own if it is of another template), without what tags or class names mark
as boilerplate, and what prose stands beside it, unless the host's other pages show that its place
holds none or the same on every page.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.operators.lookup import lookup_join
from tagwright.sources.shared import publish

_COMMENT = r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)"
# A tag ends at the first > outside a quoted value; a quote that never ends is no quote.
_TAG = re.compile(_COMMENT + r"((?>[^>=]++|=\s*+(?>\"[^\"]*\"|'[^']*')?+)*+)>", re.S)
# Where no such end comes before the end of the page, tags end at any >.
_LOOSE_TAG = re.compile(_COMMENT + r"([^>]*+)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")

# Element kinds of the HTML standard, and names that pages use for boilerplate.
RAW = set("script style textarea title xmp".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 li pre blockquote td th dt dd figcaption caption summary address".split())
CONTAINERS = set(
    "html body main article section div header footer nav aside form ul ol dl table thead tbody tfoot tr figure "
    "fieldset details dialog center noscript template button select iframe svg head object video audio canvas".split()
)
BOILER_TAGS = set(
    "nav footer aside form noscript template button select iframe svg head dialog object video audio canvas".split()
)
BOILER_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices popup modal overlay sidebar sidebars menu menus nav navbar navigation breadcrumb "
    "breadcrumbs footer comment comments commentlist disqus reply replies respond share sharing social related "
    "subscribe subscription newsletter signup login search pagination pager widget widgets toolbar masthead topbar skip "
    "complementary contentinfo alert".split()
)
# Only outside an article: what is so named inside holds its headline.
OUTER_WORDS = {"header", "heading"}
# A name tells by its last word, or by any if the last is one of these ("share-bar", "comment-body").
NEUTRAL_WORDS = set(
    "area articles bar block body box button buttons col column container content form group icon icons info inner "
    "item items law left links list main media message messages outer panel policy post posts primary right secondary "
    "section site slot stories text title top bottom unit wrap wrapper wp".split()
)
# A name with one of these says what there is not, or how the page is laid out around it.
NEGATIONS = set("no not non has with without off hide hidden disabled".split())
# Elements that hold the page: their names say how it is laid out.
NEVER_NAMED = {"html", "body", "main", "article"}
# A mark on an element with this share of the page's unlinked text does not count.
NEARLY_ALL = 0.9
# Characters that a page's vote counts at most.
PAGE_VOTE = 1000
# A longer path is written as a digest of it.
LONG_PATH = 400
# A host's judgement covers paths on more than one in so many of its pages.
PAGES_PER_PATH = 16


class Block(NamedTuple):
    """Text of one block, the path of the container it is in, whether an article or main element is
    around it, how many of its characters are links, whether it is boilerplate, and whether it is a
    first-level heading."""

    text: str
    path: str
    article: bool
    links: int
    boiler: bool
    title: bool


class Page(NamedTuple):
    """The blocks of a page in order. ``parents`` gives the path around each path (the outermost is
    the empty one) and ``depths`` how many there are; every path comes after the one around it.
    ``articles`` names the path of the outermost article or main element around a path."""

    blocks: list[Block]
    parents: dict[str, str]
    depths: dict[str, int]
    articles: dict[str, str]


class _Open:
    """An element: ``hard`` is what boilerplate tags say, ``mark`` whether a name (or being a form)
    marks it as boilerplate, ``held`` the unlinked characters in it and in what it holds."""

    __slots__ = ("tag", "path", "outer", "article", "hard", "mark", "held")

    def __init__(self, tag: str, path: str, outer: _Open | None, article: str, hard: bool, mark: bool):
        self.tag, self.path, self.outer, self.article = tag, path, outer, article
        self.hard, self.mark, self.held = hard, mark, 0


def _attribute(match: tuple[str, ...]) -> str:
    return next((x for x in match if x), "")


def _named(name: str, words: set[str]) -> bool:
    """Whether a class, id or role is one of boilerplate, by its words (also in camel case)."""
    parts = [p for p in map(str.lower, _WORD.findall(name)) if len(p) > 1]
    if not parts or not NEGATIONS.isdisjoint(parts):
        return False
    return parts[-1] in words or (parts[-1] in NEUTRAL_WORDS and not words.isdisjoint(parts))


def _marked(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NEVER_NAMED:
        return False
    words = BOILER_WORDS if in_article else BOILER_WORDS | OUTER_WORDS
    return tag == "form" or any(_named(n, words) for f in _NAMES.findall(attributes) for n in _attribute(f).split())


def _path(outer: str, tag: str, attributes: str) -> str:
    """The way to an element: tags with their classes, digits generalised. It stays short however deep
    the element is, and tells ways apart however long they are."""
    classes = _attribute(found.groups()).lower() if attributes and (found := _CLASS.search(attributes)) else ""
    step = ".".join([tag, *sorted(_DIGITS.sub("#", c).replace("/", "|") for c in classes.split())])
    if len(step) > LONG_PATH:
        step = "~" + hashlib.md5(step.encode("utf-8", "surrogatepass")).hexdigest()
    if len(outer) > LONG_PATH:
        outer = "~" + hashlib.md5(outer.encode("utf-8", "surrogatepass")).hexdigest()
    return f"{outer}/{step}"


def _judged(found: list[tuple[Block, _Open]], elements: list[_Open]) -> list[Block]:
    """The blocks with what their marks say. Marks on elements that hold nearly all unlinked text do
    not count, nor do any if everything was marked (then boilerplate tags do not either)."""
    total = 0
    for b, at in found:
        if not b.boiler:
            at.held += len(b.text) - b.links
            total += len(b.text) - b.links
    for e in reversed(elements):  # inner ones come later
        if e.outer is not None:
            e.outer.held += e.held
    inside: dict[int, bool] = {}
    for e in elements:
        own = e.mark and (not total or e.held < NEARLY_ALL * total)
        inside[id(e)] = own or (e.outer is not None and inside[id(e.outer)])
    out = [b._replace(boiler=True) if inside[id(at)] else b for b, at in found]
    if all(b.boiler for b in out):
        out = [b for b, _ in found]
    return [b._replace(boiler=False) for b in out] if all(b.boiler for b in out) else out


def _tags(html: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """``(start, end, tag)`` of what comes next in the page, and ``(length, length, None)`` at its end.
    The caller may send where to go on from. A page is read once, whatever its quotes are."""
    at, end, pattern = 0, len(html), _TAG
    while at < end:
        start = html.find("<", at)
        if start < 0:
            break
        found = pattern.match(html, start)
        if found is None and (html[start + 1 : start + 2].isalpha() or html[start + 1 : start + 2] == "/"):
            if pattern is _TAG and html[start + 1 : start + 2].isascii():
                found = _LOOSE_TAG.match(html, start)
                pattern = _LOOSE_TAG if found else pattern
            if found is None and html.find(">", start) < 0:
                break  # no tag ends any more
        if found is None:
            at = start + 1
            continue
        at = found.end()
        jump = yield start, at, found
        at = at if jump is None else jump
    yield end, end, None


def blocks(html: str | None) -> Page:
    """The text blocks of the whole page in page order; none for null or empty.

    Character references are decoded, white space within a block (line breaks too) becomes one
    space. Open elements that never end and ends without a start are borne, to any depth.
    """
    html = html or ""
    root = _Open("", "", None, "", False, False)
    out: list[tuple[Block, _Open]] = []
    elements, stack, opened = [root], [root], defaultdict(int)
    parents, depths, articles = {"": ""}, {"": 0}, {"": ""}
    parts: list[str] = []
    links, in_link, in_title = 0, 0, False
    leaf: _Open | None = None  # a leaf with a boilerplate name

    def flush() -> None:
        nonlocal links
        if parts:
            raw = "".join(parts)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                top = leaf or stack[-1]
                out.append((Block(text, top.path, bool(top.article), min(links, len(text)), top.hard, in_title), top))
            parts.clear()
        links = 0

    at, walk, jump = 0, _tags(html), None
    while True:
        try:
            start, end, found = walk.send(jump)
        except StopIteration:
            break
        jump = None
        if start > at:
            parts.append(html[at:start])
            if in_link:
                links += start - at
        at = end
        if found is None:
            break
        closing, tag, attributes = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append("\n")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag == "hr":
            flush()
        elif tag in RAW and not closing:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = jump = close.end() if close else len(html)
        elif tag in LEAVES:
            flush()
            in_title = tag == "h1" and not closing
            leaf, in_link, top = None, 0, stack[-1]
            if not closing and attributes and _marked(tag, attributes, bool(top.article)):
                leaf = _Open(tag, top.path, top, top.article, top.hard, True)
                elements.append(leaf)
        elif tag in CONTAINERS:
            flush()
            in_title, leaf, in_link = False, None, 0
            if not closing:
                if not attributes.endswith("/") or tag in ("div", "article", "section"):
                    outer = stack[-1]
                    path = _path(outer.path, tag, attributes)
                    article = outer.article or (path if tag in ("article", "main") else "")
                    hard = outer.hard or (tag in BOILER_TAGS and tag != "form") or (tag == "header" and not outer.article)
                    new = _Open(tag, path, outer, article, hard, _marked(tag, attributes, bool(outer.article)))
                    if path not in parents:
                        parents[path], depths[path], articles[path] = outer.path, depths[outer.path] + 1, article
                    elements.append(new)
                    stack.append(new)
                    opened[tag] += 1
            elif opened[tag]:
                while True:
                    last = stack.pop()
                    opened[last.tag] -= 1
                    if last.tag == tag:
                        break
    flush()
    return Page(_judged(out, elements), parents, depths, articles)


def _worth(b: Block) -> int:
    """Unlinked characters less what links weigh; 0 for boilerplate."""
    return 0 if b.boiler else max(0, len(b.text) - 3 * b.links)


def _prose(texts: list[str]) -> bool:
    """Whether a container's text reads as sentences rather than as a label."""
    return any(t[-1] in ".!?…。！？" or t.count(" ") >= 3 for t in texts)


def best_path(page: Page) -> tuple[str, float]:
    """The container a page votes for, and with what weight; an empty path if it has no text.

    It is the lowest container with nearly all good text (unlinked, no boilerplate) and, if the page
    has one, the first-level heading. If there is good text in article or main elements, only that
    counts, and the outermost such element is the lowest container.
    """
    good = [(b, w) for b in page.blocks if (w := _worth(b))]
    within = [(b, w) for b, w in good if b.article]
    held: dict[str, float] = defaultdict(float)
    for b, w in within or good:
        held[page.articles[b.path] or b.path] += w
    if not held:
        return "", 0.0
    total = sum(held.values())
    for path in reversed(page.parents):  # inner ones come later
        if path and path in held:
            held[page.parents[path]] += held[path]
    path = max((p for p, w in held.items() if w >= NEARLY_ALL * total), key=lambda p: (page.depths[p], p))
    title = next((b.path for b, _ in within or good if b.title), path)
    around = {title}
    while title:
        title = page.parents[title]
        around.add(title)
    while path not in around:
        path = page.parents[path]
    return path, held[path]


def below(page: Page, path: str) -> set[str]:
    """The path and those of all containers in it."""
    found = {path}
    for inner, outer in page.parents.items():
        if outer in found and inner:
            found.add(inner)
    return found


def text_below(page: Page, path: str) -> str:
    inside = below(page, path)
    return "\n".join(b.text for b in page.blocks if not b.boiler and b.path in inside)


def beside(page: Page, inside: set[str]) -> dict[str, list[str]]:
    """The good text outside the paths ``inside``, by path; only in article or main elements if there
    is good text in some."""
    good = [b for b in page.blocks if _worth(b)]
    within = [b for b in good if b.article]
    found: dict[str, list[str]] = defaultdict(list)
    for b in within or good:
        if b.path not in inside:
            found[b.path].append(b.text)
    return found


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(host)


VOTE = "host string, path string, text long, core long, weight long, pages long, seen long, prose long"


def _cast(page: Page) -> Iterator[tuple]:
    """A page's votes: ``(path, text, core, weight, pages, seen, prose)`` for its best path and for every
    path that holds good text. ``text`` and ``core`` are hashes of what stands in a path beside the
    best one and of the text in that; null for paths within."""
    best, weight = best_path(page)
    if not weight:
        return
    inside = below(page, best)
    core = xxhash.xxh64_intdigest("\n".join(b.text for b in page.blocks if not b.boiler and b.path in inside).encode("utf-8", "surrogatepass")) >> 1
    yield best, None, None, int(min(weight, PAGE_VOTE)), 1, 0, 0
    for path in {b.path for b in page.blocks if _worth(b) and b.path in inside}:
        yield path, None, None, 0, 0, 1, 1
    outside: dict[str, list[str]] = defaultdict(list)
    for b in page.blocks:
        if _worth(b) and b.path not in inside:
            outside[b.path].append(b.text)
    for path, texts in outside.items():
        yield path, xxhash.xxh64_intdigest("\n".join(texts).encode("utf-8", "surrogatepass")) >> 1, core, 0, 0, 1, int(_prose(texts))


def votes(pages: DataFrame) -> DataFrame:
    """``(host, path, text, core, weight, pages, seen, prose)``: the votes of all pages, no page's above
    ``PAGE_VOTE``; on how many pages the path holds good text directly, and on how many it reads as
    prose. Summed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), *[pa.int64()] * 6]
        names = [c.split()[0] for c in VOTE.split(", ")]
        for batch in batches:
            rows = [(host, *v) for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for v in _cast(blocks(html))]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    cast = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string")).mapInArrow(run, VOTE)
    return cast.groupBy("host", "path", "text", "core").agg(*[F.sum(c).alias(c) for c in ("weight", "pages", "seen", "prose")])


def by_path(cast: DataFrame) -> DataFrame:
    """``(host, path, weight, pages, seen, prose, cores, repeated)`` from ``votes``. ``cores`` counts the
    different main texts a path stands beside, ``repeated`` those of them beside which it holds what it
    holds beside another too. Copies of a page have one main text and so prove nothing."""
    sums = [F.sum(c).alias(c) for c in ("weight", "pages", "seen", "prose")]
    texts = cast.groupBy("host", "path", "text").agg(*sums, F.count("core").alias("cores"))
    again = F.sum(F.when(F.col("cores") > 1, F.col("cores")).otherwise(0)).alias("repeated")
    return texts.groupBy("host", "path").agg(*sums, F.sum("cores").alias("cores"), again)


def winners(cast: DataFrame) -> DataFrame:
    """``(host, winner, pages)``: each host's path of greatest weight (ties: more pages, then name).
    One partial aggregation, however many paths a host has."""
    best = F.max(F.when((F.col("path") != "") & (F.col("pages") > 0), F.struct("weight", "pages", "path")))
    found = cast.groupBy("host").agg(best.alias("best"), F.sum("pages").alias("n"))
    return found.select("host", F.col("best.path").alias("winner"), F.col("n").alias("pages"))


def judgements(cast: DataFrame, won: DataFrame) -> DataFrame:
    """``(host, common, refused)`` from ``by_path``: the paths that hold good text on more than half of
    their host's pages, and those that hold no part of an article: no prose on most pages that have
    them, or beside at least three main texts mostly the same. Both lists are bounded by the paths
    that a page of the host has on average."""
    at = cast.select("host", "path", "seen", "prose", "cores", "repeated").where("seen > 0")
    many = lookup_join(at, won, "host", weight="pages").where(PAGES_PER_PATH * F.col("seen") > F.col("pages"))
    label = (F.col("seen") > 1) & (2 * F.col("prose") < F.col("seen"))
    same = (F.col("cores") >= 3) & (2 * F.col("repeated") > F.col("cores"))
    return many.groupBy("host").agg(
        F.collect_set(F.when(2 * F.col("seen") > F.col("pages"), F.col("path"))).alias("common"),
        F.collect_set(F.when(label | same, F.col("path"))).alias("refused"),
    )


def page_text(page: Page, winner: str | None, common: list[str] | None, refused: list[str] | None) -> str:
    """The text below the winner if that is most of the page's good text, not counting other
    containers that most pages of the host have; else the text below the page's own vote. To it comes
    the prose beside it, in page order, except in paths that the host refuses."""
    own = best_path(page)[0]
    path = own
    if winner and winner != own and winner in page.parents:
        within, passed = below(page, winner), set(common or ())
        inside = sum(_worth(b) for b in page.blocks if b.path in within)
        other = sum(_worth(b) for b in page.blocks if b.path not in within and b.path not in passed)
        if inside >= other and inside:
            path = winner
    within = below(page, path)
    more = {p for p, texts in beside(page, within).items() if _prose(texts)}.difference(refused or ())
    return "\n".join(b.text for b in page.blocks if not b.boiler and (b.path in within or (b.path in more and _worth(b))))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    A page of which its host's winning path holds too little (``page_text``) falls back on its own
    vote. Null or empty html gives an empty text, a null url counts as a host of its own kind;
    repeated rows are extracted each; other columns are not read. What is known of hosts is broadcast
    if measured small, else joined by shuffle with the heaviest hosts spread.
    """
    cast = publish(by_path(votes(pages)), "host-votes")
    won = publish(winners(cast), "host-winners")
    known = publish(won.join(judgements(cast, won), "host", "left"), "host-paths")
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"),
        host_of(F.col("url")).alias("host"),
    )
    joined = lookup_join(rows, known, "host", weight="pages").select("page_id", "url", "html", "winner", "common", "refused")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(i).to_pylist() for i in (2, 3, 4, 5)])
            texts = [page_text(blocks(html), *of_host) for html, *of_host in rows]
            columns = [*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")

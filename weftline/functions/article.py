"""Article extraction and the gates that decide whether its result may replace the page."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from weftline.functions.dom import Node
from weftline.functions.noise import HEADINGS
from weftline.functions.render import to_html
from weftline.functions.selectors import matches_node

# Limits and priorities of the gates.
LEAST_RATIO, LEAST_LENGTH, LEAST_HEADINGS, LEAST_CODE, MOST_OPEN_LINES, LONG_LINE = 0.15, 100, 0.3, 0.15, 0.95, 20
READABLE_LENGTH, ELEMENT_CAP = 400, 20_000
CONTENT_ROOTS = "article|main|[role=main]|#content|#main-content|.content|.main-content|.post-content|.article-content|.entry-content|[itemprop=articleBody]|[data-content]|.post-body|.article-body".split("|")
INVISIBLE = frozenset("script style noscript".split())
_UNLIKELY = re.compile(r"(?i)banner|breadcrumb|combx|comment|community|disqus|extra|foot|header|menu|related|remark|rss|shout|sidebar|sponsor|pagination|pager|popup|nav")
_LIKELY = re.compile(r"(?i)article|body|column|content|main|post|text|entry")


@dataclass
class Article:
    node: Node
    title: str | None
    byline: str | None
    text: str
    excerpt: str | None


def collapsed_length(text: str) -> int:
    return len(re.sub(r"[\x00-\x20]+", " ", text).strip(" "))


def visible_text(root: Node) -> str:
    return " ".join(root.text(INVISIBLE).split())


def text_lengths(nodes: list[Node]) -> tuple[dict[int, int], dict[int, int]]:
    """Characters of visible text, and of those inside links, by the id of each of ``nodes`` (in document order): one pass from the last to the first."""
    sizes: dict[int, int] = {}
    linked: dict[int, int] = {}
    for n in reversed(nodes):
        below = [c for c in n.children if isinstance(c, Node)]
        shown = n.tag not in INVISIBLE
        sizes[id(n)] = (sum(len(c) for c in n.children if isinstance(c, str)) + sum(sizes[id(c)] for c in below)) if shown else 0
        linked[id(n)] = sizes[id(n)] if n.tag == "a" else sum(linked[id(c)] for c in below)
    return sizes, linked


def extract_article(root: Node, title: str | None = None) -> Article | None:
    """The element that gathers most paragraph text, by our own score.

    Every paragraph, pre and quote of 25 characters or more gives 1 + its commas + a point per 100 characters (three at
    most) to its parent and half of that to its grandparent; names raise or lower a candidate by 25, its link density
    takes its share off. None if the page has little text, is too large, or nothing scores.
    """
    nodes = list(root.elements())
    body = root.find("body") or root
    if len(nodes) > ELEMENT_CAP or collapsed_length(body.text(INVISIBLE)) < READABLE_LENGTH:
        return None
    scores: dict[int, float] = {}
    known: dict[int, Node] = {}
    for n in nodes:
        if n.tag not in ("p", "pre", "blockquote", "td") or n.parent is None:
            continue
        text = " ".join(n.text(INVISIBLE).split())
        if len(text) < 25:
            continue
        points = 1 + text.count(",") + min(len(text) // 100, 3)
        for above, share in ((n.parent, 1.0), (n.parent.parent, 0.5)):
            if above is None or above.tag in ("html", "#document"):
                continue
            if id(above) not in scores:
                named = f"{above.get('class')} {above.get('id')}"
                scores[id(above)] = (25 if _LIKELY.search(named) or above.tag in ("article", "main") else 0) - (25 if _UNLIKELY.search(named) or above.tag in ("nav", "aside", "footer", "header", "form") else 0)
                known[id(above)] = above
            scores[id(above)] += points * share
    sizes, linked = text_lengths(nodes) if known else ({}, {})
    best, top = None, 0.0
    for key, n in known.items():
        value = scores[key] * (1 - linked[key] / max(1, sizes[key]))
        if value > top:
            best, top = n, value
    if best is None:
        return None
    home = best.closest(lambda n: n.tag in ("article", "main")) or best
    text = home.text(INVISIBLE)
    byline = next((n.text().strip() for n in home.elements() if n.get("rel") == "author" or "author" in n.get("itemprop") or "byline" in n.get("class")), None)
    excerpt = next((t for t in (" ".join(p.text().split()) for p in home.find_all("p")) if t), None)
    return Article(home, title, byline or None, text, excerpt)


def sentences_cut(text: str) -> bool:
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if len(x) > LONG_LINE]
    return len(lines) >= 3 and sum(x[-1] not in ".!?:;" for x in lines) / len(lines) > MOST_OPEN_LINES


def retains_enough(article_length: int, page_length: int, article_headings: int, page_headings: int, article_code: int, page_code: int) -> bool:
    if page_length >= LEAST_LENGTH and article_length / page_length < LEAST_RATIO:
        return False
    if page_headings and article_headings / page_headings < LEAST_HEADINGS:
        return False
    return not (page_code and article_code / page_code < LEAST_CODE)


def retention(article_length: Column, page_length: Column, article_headings: Column, page_headings: Column, article_code: Column, page_code: Column) -> Column:
    """``retains_enough`` as an expression."""
    short = (page_length >= LEAST_LENGTH) & (article_length / page_length < LEAST_RATIO)
    headless = (page_headings > 0) & (article_headings / F.nullif(page_headings, F.lit(0)) < LEAST_HEADINGS)
    codeless = (page_code > 0) & (article_code / F.nullif(page_code, F.lit(0)) < LEAST_CODE)
    return ~(F.coalesce(short, F.lit(False)) | F.coalesce(headless, F.lit(False)) | F.coalesce(codeless, F.lit(False)))


def use_article(article: Article, root: Node) -> bool:
    count = lambda n, tags: len(n.find_all(*tags))
    enough = retains_enough(len(article.text), len(visible_text(root)), count(article.node, HEADINGS), count(root, HEADINGS), count(article.node, ("pre",)), count(root, ("pre",)))
    return enough and not sentences_cut(article.text)


def content_root(root: Node) -> Node | None:
    """The first element of the first selector, in order, whose inner HTML has more than 100 characters."""
    nodes = list(root.elements())
    for selector in CONTENT_ROOTS:
        found = next((n for n in nodes if matches_node(n, selector)), None)
        if found is not None and len(to_html(found).strip()) > 100:
            return found
    return None


# ---- as expressions


def collapsed_length_of(text: Column, most: int) -> Column:
    """Length with every run of control characters and spaces as one, trimmed, up to ``most``."""
    return F.least(F.length(F.trim(F.regexp_replace(text, r"[\x00-\x20]+", " "))), F.lit(most))


def needs_wrapper(html: Column) -> Column:
    """Whether markup is a fragment that lacks a document around it."""
    low = F.lower(F.substring(F.regexp_replace(html, r"^\s+", ""), 1, 9))
    return ~(low.startswith("<!doctype") | low.startswith("<html") | low.startswith("<body"))


def wrap_fragment(html: Column) -> Column:
    return F.when(needs_wrapper(html), F.concat(F.lit("<!DOCTYPE html><html><body>"), html, F.lit("</body></html>"))).otherwise(html)


def valid_input(html: Column, url: Column) -> Column:
    return (F.coalesce(html, F.lit("")) != "") & (F.coalesce(url, F.lit("")) != "")

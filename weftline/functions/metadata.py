"""Page metadata from head elements."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import functions as F, types as T

from weftline.functions.dom import Node, parse
from weftline.functions.urls import absolute

FIELDS = ("title", "description", "author", "image", "favicon", "published_at", "modified_at")
HEAD_WINDOW = 50_000

# Which meta key fills which slot.
PROPERTIES = {"og:title": ("title", 0), "og:description": ("description", 0), "og:image": ("image", 0), "article:published_time": ("published_at", 0), "article:modified_time": ("modified_at", 0)}
NAMES = {"twitter:title": ("title", 1), "twitter:description": ("description", 1), "description": ("description", 2), "author": ("author", 0)}


def extract_metadata(root: Node, url: str | None = None) -> dict[str, str | None]:
    """The seven fields; social tags win over plain ones, later tags over earlier ones."""
    slots: dict[tuple[str, int], str] = {}
    for node in root.find_all("meta"):
        content = node.get("content").strip()
        if content:
            for slot in (PROPERTIES.get(node.get("property")), NAMES.get(node.get("name"))):
                if slot:
                    slots[slot] = content
    title = root.find("title")
    if title is not None and title.text().strip():
        slots[("title", 2)] = title.text().strip()
    found = {f: next((slots[f, i] for i in range(3) if (f, i) in slots), None) for f in FIELDS}
    icon = next((n for n in root.find_all("link") if n.get("rel") == "icon" and n.get("sizes") == "32x32"), None)
    if icon is not None and url:
        found["favicon"] = favicon(icon.get("href"), url)
    return found


def favicon(href: str, base: str) -> str | None:
    target = href.strip()
    if not target or target.lower().startswith("data:"):
        return None
    full = absolute(target, base)
    return full if urlsplit(full).scheme in ("http", "https") else None


def head_section(html: str) -> str | None:
    """The part of the page up to its head's end or body's start, in the first HEAD_WINDOW characters."""
    m = re.search(r"(?i)</head\s*>|<body\b", html[:HEAD_WINDOW])
    return html[: m.start()] if m else None


def early_metadata(html: str, url: str | None = None) -> dict[str, str | None] | None:
    """Metadata of the head alone, for pages that are cut before they are parsed."""
    head = head_section(html)
    return extract_metadata(parse(head), url) if head else None


def merge_metadata(early: dict[str, str | None] | None, late: dict[str, str | None]) -> dict[str, str | None]:
    """Later values win; the icon is only taken from the later ones."""
    if not early:
        return late
    return {f: late.get(f) or (early.get(f) if f != "favicon" else None) for f in FIELDS}


@F.pandas_udf(T.StructType([T.StructField(f, T.StringType()) for f in FIELDS]))
def page_metadata(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    """A page's metadata as a struct; null pages give nulls."""
    return pd.DataFrame([extract_metadata(parse(h), u) for h, u in zip(html, url)], columns=list(FIELDS), dtype=object)

"""Main text of web pages by minimum-cut labelling.

A page's text falls into blocks at block-level element boundaries. A linear classifier of a block's prose, and what the
elements around it say, give its log-odds of being content; they become capacities from the source (content) or to the
sink (boilerplate). Neighbouring blocks are tied by smoothness edges, the stronger the nearer they stand in the tree. The
minimum cut is the labelling of least cost; what the source still reaches in the residual graph is content. So a short
line between paragraphs of an article stays with them, and a sentence between links goes.

The classifier's weights start from PRIOR and are fitted to a bounded sample of pages whose markup labels their blocks
(inside article or main, or inside navigation, footers and the like); the markup itself is no feature of the fit.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from weftline.functions.dom import BLOCK, Node, parse

from .common import batches, lowest, plain_names, read

#: Never text of a page, whatever the labels say.
SILENT = frozenset("head script style noscript template svg canvas iframe object embed audio video map select option datalist textarea button input title meta link".split())
CONTROLS = frozenset("input select textarea button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are text themselves: a word in their class is a weak hint.
TEXTUAL = frozenset("p blockquote pre figure figcaption table td th tr li dd dt caption".split()) | HEADINGS
#: Words of class and id names.
CUES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted cookie cookies consent gdpr nav navbar navigation menu menus breadcrumb breadcrumbs sidebar "
    "newsletter subscribe signup login related recommended recommendations popup modal pager pagination footer masthead topbar toolbar skip share sharing".split()
)
COMMENT_CUES = frozenset("comment comments disqus reply replies respond".split())
HINTS = frozenset("banner overlay notice notices alert aside rail widget widgets social header discussion subscription disclaimer legal copyright tags toc promotion side foot".split())
CONTENT_CUES = frozenset("article content post entry story prose".split())
#: Words that leave a class name as plain as it is: a name made of these and cues alone is a clear cue, any other a hint.
NEUTRAL = CONTENT_CUES | HINTS | frozenset(
    "wrapper container box block list item slot unit area section inner outer left right top bottom main site page global primary secondary bar bars btn button buttons icon icons group link links text col row wrap holder panel body form thread".split()
)
#: Evidence of the elements around a block, in log-odds: the strongest one against it counts, and that of a content region.
AGAINST = {"nav": -6.0, "footer": -5.0, "aside": -4.0, "header": -3.5, "dialog": -6.0, "form": -5.0, "comments": -8.0, "cue": -5.0, "hint": -2.0, "label": -2.0}
REGION, OUTSIDE, CONTENT_CUE = 0.5, -1.0, 0.5
#: Where no element says anything, there is nothing but the text.
SILENT_PAGE = 1.5
#: A form with less text than this for each of its controls is one to fill in.
CHARS_PER_CONTROL = 300
#: Smoothness of blocks with one parent; it halves with every two further steps between them in the tree, and falls to
#: BORDER of that where an element that speaks against its blocks begins or ends between them.
TIE, BORDER = 1.6, 0.2
MOST = 8.0
_SCALE = 1000
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7af]")  # scripts that write words without spaces, about two signs each
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

FEATURES = ("one", "log_words", "sentence_end", "stops_per_word", "linked", "heading", "item", "cell")
PRIOR = (-2.0, 0.9, 0.8, 1.5, -4.0, 1.5, 1.2, 1.2)
#: Bounds of the fit: pages (those lowest by a hash), blocks of each (likewise), and how strongly PRIOR holds.
FIT_PAGES = 400
FIT_BLOCKS = 50
HOLD = 40.0


class Page:
    """A page's blocks in page order, and the elements that say something about them, as intervals of blocks."""

    def __init__(self, root: Node):
        self.texts: list[str] = []
        self.linked: list[int] = []
        self.heading: list[bool] = []
        self.item: list[bool] = []
        self.cell: list[bool] = []
        self.home: list[int] = []  # depth of the block's element
        self.meet: list[int] = []  # depth of the element that it shares with the block before
        self.parent: list[int] = []
        self.marks: list[tuple[str, int, int]] = []  # kind, first block, end
        self.controls: list[tuple[int, int, int]] = []
        self._walk(root)

    def _walk(self, root: Node) -> None:
        parts: list[str] = []
        linked, home, parent, at_depth, low, controls = 0, root, id(root), 0, 0, 0
        heading = item = cell = False

        def flush() -> None:
            nonlocal linked, low
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                self.texts.append(text)
                self.linked.append(min(linked, len(text)))
                self.heading.append(heading)
                self.item.append(item)
                self.cell.append(cell)
                self.home.append(at_depth)
                self.meet.append(min(low, at_depth))
                self.parent.append(parent)
                low = at_depth
            linked = 0

        # (node or text, depth, inside a link, heading, list item, inside a region) going in; (None, ...) going out
        stack: list[tuple] = [(c, 1, False, False, False, False) for c in reversed(root.children)]
        while stack:
            node, depth, link, head, li, region = stack.pop()
            if node is None:
                block, kinds, first, before, outer = depth
                if block:
                    flush()
                    home, parent, at_depth, heading, item, cell = outer
                    low = min(low, at_depth)
                for kind in kinds:
                    if kind == "form":
                        self.controls.append((first, len(self.texts), controls - before))
                    else:
                        self.marks.append((kind, first, len(self.texts)))
            elif isinstance(node, str):
                parts.append(node)
                if link:
                    linked += len(" ".join(node.split()))
            elif node.tag == "br":
                parts.append(" ")
            elif node.tag in SILENT:
                controls += node.tag in CONTROLS
                parts.append(" " if node.tag in BLOCK else "")
            elif node.attrs and hidden(node):
                parts.append(" " if node.tag in BLOCK else "")
            else:
                kinds = evidence(node, region)
                block = node.tag in BLOCK
                if block:
                    flush()
                    outer = (home, parent, at_depth, heading, item, cell)
                    parent = id(home)
                    home, at_depth, heading = node, depth, head or node.tag in HEADINGS
                    item, cell = li or node.tag in ("li", "dt", "dd"), node.tag in ("td", "th")
                if block or kinds:
                    stack.append((None, (block, kinds, len(self.texts), controls, outer if block else None), False, False, False, False))
                region = region or "region" in kinds
                link, head, li = link or node.tag == "a", head or node.tag in HEADINGS, li or node.tag in ("li", "dt", "dd")
                stack += [(c, depth + 1, link, head, li, region) for c in reversed(node.children)]
        flush()


def hidden(node: Node) -> bool:
    return "hidden" in node.attrs or node.get("aria-hidden").lower() == "true" or bool(_HIDDEN.search(node.get("style")))


def evidence(node: Node, inside: bool) -> list[str]:
    """What an element says about its blocks by name, role, class and id; ``inside`` a content region headers are the article's own."""
    tag, role = node.tag, node.get("role").lower() if node.attrs else ""
    if tag in ("body", "html"):
        return []
    found = []
    if tag in ("article", "main") or role in ("article", "main"):
        found.append("region")
        if tag == "main" or role == "main":
            found.append("main")
    if tag in ("nav", "menu", "search") or role in ("navigation", "menu", "menubar", "search", "toolbar"):
        found.append("nav")
    if tag == "footer" or role == "contentinfo":
        found.append("footer")
    if tag == "aside" or role == "complementary":
        found.append("aside")
    if (tag == "header" or role == "banner") and not inside:
        found.append("header")
    if tag == "dialog" or role in ("dialog", "alertdialog"):
        found.append("dialog")
    if tag == "form":
        found.append("form")
    if tag in ("label", "legend"):
        found.append("label")
    if tag == "h1":
        found.append("h1")
    for name in f"{node.get('class')} {node.get('id')}".split() if node.attrs else ():
        words = {w.lower() for w in _WORDS.findall(name)}
        hints = words & HINTS - ({"header"} if inside else set())
        if words & (CUES | COMMENT_CUES) or hints:
            clear = words & (CUES | COMMENT_CUES) and tag not in TEXTUAL and all(w in CUES or w in COMMENT_CUES or w in NEUTRAL or w.isdigit() for w in words)
            found.append("hint" if not clear else "comments" if words & COMMENT_CUES else "cue")
        elif words & CONTENT_CUES:
            found.append("content")
    return found


def features(page: Page) -> np.ndarray:
    """FEATURES of each block: its prose alone, nothing of the markup around it."""
    out = np.zeros((len(page.texts), len(FEATURES)))
    for i, text in enumerate(page.texts):
        words = text.count(" ") + 1 + (0 if text.isascii() else len(_WIDE.findall(text)) // 2)
        stops = sum(map(text.count, ".,;:!?" if text.isascii() else ".,;:!?。、，；：！？"))
        out[i] = (1, math.log1p(words), text.rstrip("\"'”»)」")[-1:] in ".!?…:。！？", min(0.3, stops / words), page.linked[i] / len(text), page.heading[i], page.item[i], page.cell[i])
    return out


def structure(page: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each block: log-odds of the elements around it, whether it is in a content region, whether an element speaks against it.

    An element that holds most of the page's unlinked text together with its article, main element or first heading wraps
    the page, whatever it is called, and says nothing.
    """
    n = len(page.texts)
    prose = np.concatenate(([0], np.cumsum([len(t) - x for t, x in zip(page.texts, page.linked)])))
    whole = max(1, int(prose[-1]))
    anchors = [next(((a, b) for k, a, b in page.marks if k == "main"), None), min(((a, b) for k, a, b in page.marks if k == "region"), default=None, key=lambda x: (x[0], -x[1])), min(((a, b) for k, a, b in page.marks if k == "h1"), default=None)]
    anchors = [x for x in anchors if x and x[1] > x[0]]

    def wraps(kind: str, a: int, b: int) -> bool:
        share = (prose[b] - prose[a]) / whole
        return share > 0.5 and any(a <= x and y <= b for x, y in anchors) or share > 0.8 and kind != "comments"

    marks = list(page.marks)
    for a, b, controls in page.controls:
        if controls and (prose[b] - prose[a]) / controls < CHARS_PER_CONTROL:
            marks.append(("form", a, b))
    cover = {k: np.zeros(n + 1, np.int64) for k in (*AGAINST, "region", "content")}
    for kind, a, b in marks:
        if kind in cover and (kind not in AGAINST or not wraps(kind, a, b)):
            cover[kind][a] += 1
            cover[kind][b] -= 1
    on = {k: np.cumsum(v)[:n] > 0 for k, v in cover.items()}
    against = np.min([np.where(on[k], w, 0.0) for k, w in AGAINST.items()], axis=0) if n else np.zeros(0)
    if not any(x.any() for x in on.values()):
        return np.full(n, SILENT_PAGE), on["region"], on["region"]
    odds = against + np.where(on["region"], REGION, OUTSIDE if on["region"].any() else 0.0) + np.where(on["content"], CONTENT_CUE, 0.0)
    return odds, on["region"], against < -3


def log_odds(page: Page, weights: np.ndarray | None = None, around: np.ndarray | None = None) -> np.ndarray:
    around = structure(page)[0] if around is None else around
    return np.clip(features(page) @ (np.array(PRIOR) if weights is None else weights) + around, -MOST, MOST)


def ties(page: Page, against: np.ndarray) -> list[tuple[int, int, int]]:
    """Smoothness edges (i, j, capacity): every block with its successor, and with the next one of the same parent element."""
    out = []
    border = lambda i, j: BORDER if against[i] != against[j] else 1.0
    last: dict[int, int] = {}
    for i in range(len(page.texts)):
        if i:
            steps = max(0, page.home[i - 1] - page.meet[i]) + max(0, page.home[i] - page.meet[i])
            out.append((i - 1, i, round(_SCALE * TIE * 2.0 ** (-max(0, steps - 2) / 2) * border(i - 1, i))))
        before = last.get(page.parent[i])
        if before is not None and before < i - 1:
            out.append((before, i, round(_SCALE * TIE / 2 * border(before, i))))
        last[page.parent[i]] = i
    return [e for e in out if e[2]]


def minimum_cut(odds: list[float], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which blocks stay with the source: Dinic's maximum flow over terminal and smoothness capacities."""
    n = len(odds)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, x in enumerate(odds):
        capacity = round(abs(x) * _SCALE)
        if x > 0:
            edge(source, i, capacity, 0)
        elif x < 0:
            edge(i, sink, capacity, 0)
    for a, b, c in edges:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if not room[e])
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if not path:
                    break
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1
                continue
            path.append(e)
            a = to[e]


def labels(page: Page, weights: np.ndarray | None = None) -> list[bool]:
    """Which blocks are content: the source's side of the minimum cut."""
    if not page.texts:
        return []
    around, _, against = structure(page)
    return minimum_cut(log_odds(page, weights, around).tolist(), ties(page, against))


def main_text(html: str | None, weights: np.ndarray | None = None) -> str:
    """The main text: blocks in page order, joined by line feeds; empty for null, empty or text-less pages."""
    page = Page(parse(html))
    return "\n".join(t for t, k in zip(page.texts, labels(page, weights)) if k)


def fit(pages: DataFrame, html: str = "html") -> np.ndarray:
    """The classifier's weights by penalised logistic regression around PRIOR, on blocks that their page's markup labels.

    Bounded: FIT_PAGES pages, those lowest by a hash of their html (copies count once), and of each FIT_BLOCKS labelled
    blocks, those lowest by a hash of their text. Without labelled blocks the weights are PRIOR.
    """
    h = F.xxhash64(html)
    chosen = pages.filter(F.col(html).isNotNull()).select(F.col(html).alias("html"), h.alias("h"))
    few = chosen.filter(lowest(F.col("h"), FIT_PAGES, pages.count()))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, "html"):
            rows: list[tuple[int, bytes]] = []
            for key, text in zip(batch.column("h").to_pylist(), batch.column("html").to_pylist()):
                page = Page(parse(text))
                _, region, against = structure(page)
                x = features(page)
                some = [i for i in range(len(page.texts)) if region[i] or against[i]]
                some = sorted(some, key=lambda i: xxhash.xxh64_intdigest(page.texts[i]))[:FIT_BLOCKS]
                rows.append((key, np.column_stack((~against[some], x[some])).astype("<f8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["h", "x"])

    found = few.mapInArrow(run, "h long, x binary").groupBy("h").agg(F.min("x").alias("x"))
    sample = found.orderBy(F.pmod("h", F.lit(1 << 31)), "h").limit(FIT_PAGES).collect()
    table = np.frombuffer(b"".join(r["x"] for r in sample), "<f8").reshape(-1, 1 + len(FEATURES))
    return regression(table[:, 1:], table[:, 0])


def regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of least logistic loss plus HOLD / 2 times their squared distance from PRIOR, by Newton's method; both labels weigh alike."""
    prior = np.array(PRIOR)
    w = prior.copy()
    if not 0 < y.sum() < len(y):
        return w
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + HOLD * (w - prior)
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + HOLD * np.eye(len(w)), gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return np.round(w, 6)


def extract(pages: DataFrame, html: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """``pages`` without ``html``, with text and n_chars (columns of those names, in any case, give way).

    ``weights`` are those of ``fit``, or PRIOR. No row is dropped or merged; null or empty html gives an empty text.
    """
    kept, originals = plain_names(pages.select(*[F.col(f"`{c}`") for c in pages.columns if c == html or c.lower() not in ("text", "n_chars")]))
    rest = [c for c in kept.columns if c != html]
    schema = T.StructType([*[f for f in kept.schema.fields if f.name != html], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, html):
            texts = [main_text(x, weights) for x in batch.column(html).to_pylist()]
            texts_ = pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], texts_, pa.array([len(t) for t in texts], pa.int64())], names=[*rest, "text", "n_chars"])

    return kept.mapInArrow(run, schema).withColumnsRenamed(originals)


def op10_main_text(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, weights=fit(pages))

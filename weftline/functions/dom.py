"""A small HTML tree: a tolerant tokenizer, implied end tags, and the queries that the extraction operators need.

Only documented rules: void elements have no content; script, style and the like hold raw text up to their end tag;
a block start ends an open paragraph; list items, table parts and options end their predecessors; an end tag closes
up to the nearest open element of its name, if there is one that no table cell or similar shields.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from html import unescape

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RAW_DECODED = frozenset("textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li legend main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption colgroup head title".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "li main menu nav ol p pre search section summary table ul".split()
)
HEAD_ONLY = frozenset("base basefont bgsound link meta noscript script style template title".split())
SHIELD = frozenset("table td th caption button object applet marquee template html".split())
#: A start tag ends the open elements named here, up to the first element of the second set.
IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset("table tbody thead tfoot".split())),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tbody": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
}

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<start2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S,
)
#: A tag that ``_TOKEN`` takes alike wherever it stands: a plain name, attributes in double quotes. A page of such tags alone is cut up at once.
_SIMPLE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*+)((?:\s++[a-zA-Z][a-zA-Z0-9-]*+=\"[^\"<>]*+\")*+)>")
#: Names whose start tag does more than open an element.
_PAGE = frozenset(("html", "body", "head"))
_UNPARSED = RAW | RAW_DECODED
_CHILDLESS = VOID | _UNPARSED
_MARKED = _CHILDLESS | ENDS_PARAGRAPH | frozenset(IMPLIED) | _PAGE
_DRAWN = frozenset("svg path circle rect line use g polygon".split())
_ATTR = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    """An element; ``children`` holds elements and text strings in order."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    def elements(self) -> Iterator[Node]:
        """All elements below, in document order, without recursion."""
        stack = [c for c in reversed(self.children) if c.__class__ is Node]
        while stack:
            node = stack.pop()
            yield node
            if node.children:
                stack += [c for c in reversed(node.children) if c.__class__ is Node]

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.elements() if n.tag in tags), None)

    def find_all(self, *tags: str) -> list[Node]:
        return [n for n in self.elements() if n.tag in tags]

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def closest(self, match: Callable[[Node], bool]) -> Node | None:
        return self if match(self) else next((n for n in self.ancestors() if match(n)), None)

    def text(self, skip: frozenset[str] = frozenset()) -> str:
        out: list[str] = []
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
            elif item.tag not in skip:
                stack += reversed(item.children)
        return "".join(out)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def classes(self) -> list[str]:
        return self.get("class").split()


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTR.findall(source):
        found.setdefault(name.lower(), unescape(next(filter(None, values), "")))
    return found


class _Builder:
    """The tree being built: the open elements, and what a tag or a text does to them."""

    __slots__ = ("root", "stack", "opened", "nodes")

    def __init__(self) -> None:
        self.root = Node("#document")
        self.stack, self.nodes = [self.root], []
        self.opened: defaultdict[str, int] = defaultdict(int)  # how many elements of each name are open, so that no start or end tag searches in vain

    def text(self, text: str) -> None:
        if text:
            children = self.stack[-1].children
            if children and isinstance(children[-1], str):
                children[-1] += text
            else:
                children.append(text)

    def close_through(self, depth: int) -> None:
        for n in self.stack[depth:]:
            self.opened[n.tag] -= 1
        del self.stack[depth:]

    def end(self, name: str) -> None:
        stack = self.stack
        if name == "br":
            self.nodes.append(Node("br", None, stack[-1]))
            stack[-1].children.append(self.nodes[-1])
            return
        for depth in range(len(stack) - 1, 0, -1) if self.opened[name] else ():
            if stack[depth].tag == name:
                self.close_through(depth)
                break
            if stack[depth].tag in SHIELD and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") and name not in SHIELD:
                break

    def start(self, name: str, source: str) -> Node | None:
        """The new element, left open unless it is a void one; none where an html, head or body is open already."""
        stack, opened = self.stack, self.opened
        if name in _PAGE and opened[name]:
            same = next((n for n in stack if n.tag == name), None)
            if same is not None:
                for key, value in attributes(source).items():
                    same.attrs.setdefault(key, value)
                return None
        if stack[-1].tag == "head" and name not in HEAD_ONLY:
            self.close_through(len(stack) - 1)
        if opened["p"] and name in ENDS_PARAGRAPH:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    self.close_through(depth)
                    break
                if stack[depth].tag in SHIELD:
                    break
        top = stack[-1]
        ended = IMPLIED.get(name)
        if ended and top.tag not in ended[1] and any(map(opened.get, ended[0])):
            cut = 0
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ended[1]:
                    break
                if stack[depth].tag in ended[0]:
                    cut = depth
            if cut:
                self.close_through(cut)
                top = stack[-1]
        node = Node(name, attributes(source) if source and not source.isspace() else None, top)
        top.children.append(node)
        self.nodes.append(node)
        if name in _CHILDLESS or source and name in _DRAWN and source.rstrip().endswith("/"):
            return node
        stack.append(node)
        opened[name] += 1
        return node


def _simple_tree(html: str) -> _Builder | None:
    """A page of simple tags alone, none where it holds anything else."""
    parts = _SIMPLE.split(html)
    last = parts.pop()
    if "<" in last:
        return None
    build = _Builder()
    stack, opened, nodes = build.stack, build.opened, build.nodes
    pieces = iter(parts)
    for text, slash, name, source in zip(pieces, pieces, pieces, pieces):
        top = stack[-1]
        if text:
            if "<" in text:
                return None
            if "&" in text:
                build.text(unescape(text))
            elif top.children and top.children[-1].__class__ is str:
                top.children[-1] += text
            else:
                top.children.append(text)
        name = name.lower()
        if slash:
            if source:
                return None
            if top.tag == name:
                stack.pop()
                opened[name] -= 1
            else:
                build.end(name)
        elif name not in _MARKED and top.tag != "head":
            node = Node(name, attributes(source) if source else None, top)
            top.children.append(node)
            nodes.append(node)
            stack.append(node)
            opened[name] += 1
        elif name in _UNPARSED:
            return None
        else:
            build.start(name, source)
    build.text(unescape(last))
    return build


def parse(html: str | None) -> Node:
    """The tree of a document or fragment; the root is a node ``#document`` whose content may lack html, head and body."""
    return parse_elements(html)[0]


def parse_elements(html: str | None) -> tuple[Node, list[Node]]:
    """``parse``, and all elements in document order."""
    if not html:
        return Node("#document"), []
    build = _simple_tree(html) or _tree(html)
    return build.root, build.nodes


def _tree(html: str) -> _Builder:
    build = _Builder()
    at = 0
    lower = None
    while True:
        open_at = html.find("<", at)
        if open_at < 0:
            build.text(unescape(html[at:]))
            break
        m = _TOKEN.match(html, open_at)
        if m is None:
            build.text(unescape(html[at : open_at + 1]))
            at = open_at + 1
            continue
        if open_at > at:
            build.text(unescape(html[at:open_at]))
        at = m.end()
        cdata, end, name, source, name2, source2 = m.groups()
        if cdata is not None:
            build.text(cdata)
        if end:
            build.end(end.lower())
            continue
        if not name:
            name, source = name2, source2
        if not name:
            continue
        name = name.lower()
        node = build.start(name, source)
        if node is not None and name in _UNPARSED:
            if lower is None:
                lower = html.lower() if len(html.lower()) == len(html) else re.sub("[A-Z]", lambda x: x[0].lower(), html)
            close = lower.find(f"</{name}", at)
            body = html[at : close if close >= 0 else len(html)]
            if body:
                node.children.append(unescape(body) if name in RAW_DECODED else body)
            if close < 0:
                break
            close_end = html.find(">", close)
            at = close_end + 1 if close_end >= 0 else len(html)
    return build

"""HTML trees as Markdown: ATX headings, dash bullets, underscore emphasis, fenced code; and trees as HTML again."""

from __future__ import annotations

import re
from html import escape

from weftline.functions.codelang import language_from_attributes, language_of
from weftline.functions.dom import BLOCK, RAW, VOID, Node
from weftline.functions.urls import alt_of

# Class words of admonitions, and their alert type, the first that the class contains.
ALERTS = (("note", "NOTE"), ("info", "NOTE"), ("tip", "TIP"), ("hint", "TIP"), ("warning", "WARNING"), ("warn", "WARNING"), ("caution", "CAUTION"), ("danger", "CAUTION"), ("important", "IMPORTANT"))
ADMONITION = re.compile(r"admonition|callout|custom-block")
ADMONITION_WORD = re.compile(r"\b(?:note|tip|info|warning|danger|caution|important)\b", re.I)
LAZY_SOURCES = ("data-src", "data-lazy-src", "data-original", "data-srcset")
ESCAPED = re.compile(r"[\\`*_~]")
SILENT = frozenset("script style noscript template head title meta link svg canvas iframe object select option textarea button input".split())
WRAPS = {"kbd": ("`", "`"), "mark": ("==", "=="), "sub": ("~", "~"), "sup": ("^", "^"), "strong": ("**", "**"), "b": ("**", "**"), "em": ("_", "_"), "i": ("_", "_"), "del": ("~~", "~~"), "s": ("~~", "~~"), "strike": ("~~", "~~")}


def to_html(node: Node) -> str:
    """The inner HTML of a node."""
    out: list[str] = []
    stack: list[tuple[str, object]] = [("node", c) for c in reversed(node.children)]
    while stack:
        kind, item = stack.pop()
        if kind == "text":
            out.append(item)
        elif isinstance(item, str):
            out.append(escape(item, quote=False))
        else:
            out.append(f"<{item.tag}" + "".join(f' {k}="{escape(v)}"' for k, v in item.attrs.items()) + ">")
            if item.tag not in VOID:
                stack.append(("text", f"</{item.tag}>"))
                if item.tag in RAW:
                    out += [c for c in item.children if isinstance(c, str)]
                else:
                    stack += [("node", c) for c in reversed(item.children)]
    return "".join(out)


def inline_code(text: str) -> str:
    body = text.strip()
    if not body:
        return "``"
    ticks = "`" * (max((len(r) for r in re.findall("`+", body)), default=0) + 1)
    pad = " " if body[0] == "`" or body[-1] == "`" else ""
    return f"{ticks}{pad}{body}{pad}{ticks}"


def first_of_srcset(value: str) -> str:
    words = value.split(",")[0].split()
    return words[0] if words else ""


def image_source(node: Node) -> str:
    """The first source that is no data URI: src, lazy attributes, srcset."""
    src = node.get("src")
    choices = [src, *[first_of_srcset(node.get(a)) if a == "data-srcset" else node.get(a) for a in LAZY_SOURCES], first_of_srcset(node.get("srcset"))]
    return next((c for c in choices if c and not c.startswith("data:")), "[data URI removed]" if src.startswith("data:") else "")


def _language(node: Node) -> str | None:
    own = language_from_attributes(node.get("class"), node.get("data-language"))
    code = next((c for c in node.children if isinstance(c, Node) and c.tag == "code"), None)
    return own or (language_from_attributes(code.get("class"), code.get("data-language")) if code else None)


def _raw_text(node: Node) -> str:
    parts: list[str] = []
    stack: list[Node | str] = list(reversed(node.children))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            parts.append(item)
        elif item.tag == "br":
            parts.append("\n")
        else:
            stack += reversed(item.children)
    return "".join(parts)


def _block(text: str) -> str:
    body = text.strip("\n")
    return f"\n\n{body}\n\n" if body.strip() else ""


_BLANK_LINES = re.compile(r"\n[ \t]*\n(?:[ \t]*\n)+")


def _fold(text: str) -> str:
    """At most one blank line between blocks, none at the ends."""
    return (_BLANK_LINES.sub("\n\n", text) if "\n" in text else text).strip()


_SPACES = re.compile(r"[ \t\r\n\f]+")
#: What makes a text other than it is: signs to escape, white space that is no single space.
_CHANGES = re.compile(r"[\\`*_~\t\r\n\f]|  ")
_SPANS = re.compile("[2-9]")
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))


#: Elements whose content is not rendered, and the parts of a table that are.
_CLOSED = SILENT | {"pre"}
_OF_TABLE = frozenset(("td", "th", "caption"))


def _escaped(m: re.Match) -> str:
    return "\\" + m[0]


class Renderer:
    """Renders children before parents with an explicit stack, so deep pages do not overflow."""

    def render(self, root: Node) -> str:
        done: dict[int, str] = {}
        order, stack = [], [root]
        while stack:  # parents before children
            node = stack.pop()
            order.append(node)
            if node.children and node.tag not in _CLOSED:
                inside = [c for c in node.children if c.__class__ is Node]
                while node.tag == "table" and inside:  # a table takes its cells and its caption, whatever they lie in
                    n = inside.pop()
                    if n.tag in _OF_TABLE:
                        stack.append(n)
                    elif n.children and n.tag not in _CLOSED:
                        inside += [c for c in n.children if c.__class__ is Node]
                stack += inside
        element = self.element
        for node in reversed(order):
            done[id(node)] = element(node, done)
        return _fold(done[id(root)])

    def inner(self, node: Node, done: dict[int, str]) -> str:
        out, children = "", node.children
        if len(children) == 1 and children[0].__class__ is str:
            text = children[0]
            return (ESCAPED.sub(_escaped, _SPACES.sub(" ", text)) if _CHANGES.search(text) else text).lstrip(" ")
        for c in children:
            if c.__class__ is str:
                text = ESCAPED.sub(_escaped, _SPACES.sub(" ", c)) if _CHANGES.search(c) else c
                if text[:1] == " " and (not out or out[-1] in "\n "):
                    text = text.lstrip(" ")
                out += text
            else:
                piece = done.get(id(c), "")
                if piece[:1] == "\n":
                    out = out.rstrip(" ")
                out += piece
        return out

    def element(self, node: Node, done: dict[int, str]) -> str:
        tag = node.tag
        if tag in SILENT:
            return ""
        rule = _RULES.get(tag)
        if rule is not None:
            return rule(self, node, done)
        if tag in WRAPS:
            text = self.inner(node, done)
            body = text.strip()
            left, right = WRAPS[tag]
            if tag in ("kbd", "mark", "sub", "sup"):
                return f"{left}{text}{right}"
            if not body or "\n\n" in body:
                return text
            return text[: len(text) - len(text.lstrip())] + left + body + right + text[len(text.rstrip()) :]
        if tag in HEADINGS:
            text = " ".join(self.inner(node, done).split())
            return f"\n\n{'#' * int(tag[1])} {text}\n\n" if text else ""
        text = self.inner(node, done)
        return _block(text) if tag in BLOCK else text

    def _br(self, node, done):
        return "  \n"

    def _hr(self, node, done):
        return "\n\n---\n\n"

    def _a(self, node, done):
        text = " ".join(self.inner(node, done).split())
        href = node.get("href").strip()
        if not href:
            return text
        return f"[{text}]({href})" if text else ""

    def _img(self, node, done):
        src = image_source(node)
        mark = f"![{node.get('alt').strip() or alt_of(src)}]({src})"
        return mark if node.parent is not None and node.parent.tag == "a" else f"\n\n{mark}\n\n"

    def _code(self, node, done):
        return inline_code(_raw_text(node))

    def _pre(self, node, done):
        text = _raw_text(node)
        if "mermaid" in node.get("class"):
            return f"\n\n```mermaid\n{text.strip()}\n```\n\n"
        body = text.strip()
        fence = "`" * max(3, max((len(r) for r in re.findall("`+", body)), default=0) + 1)
        return f"\n\n{fence}{_language(node) or language_of(body) or ''}\n{body}\n{fence}\n\n" if body else ""

    def _blockquote(self, node, done):
        body = _fold(self.inner(node, done))
        return "\n\n" + "\n".join(f"> {x}".rstrip() for x in body.split("\n")) + "\n\n" if body else ""

    def _list(self, node, done, numbered):
        items = []
        start = int(node.get("start")) if re.fullmatch(r"\d{1,9}", node.get("start")) else 1
        for c in node.children:
            if not isinstance(c, Node):
                continue
            body = _fold(done.get(id(c), ""))
            if c.tag in ("ul", "ol"):
                items += ["  " + x for x in body.split("\n")] if body else []
                continue
            if not body:
                continue
            body = re.sub(r"\n\n((?:[-*+]|\d+\.) )", r"\n\1", body)
            lead = f"{start + sum(1 for x in items if not x.startswith(' '))}. " if numbered else "- "
            first, *rest = body.split("\n")
            items.append(lead + first)
            items += [f"  {x}" if x.strip() else "" for x in rest]
        return "\n\n" + "\n".join(items) + "\n\n" if items else ""

    def _ul(self, node, done):
        return self._list(node, done, False)

    def _ol(self, node, done):
        return self._list(node, done, True)

    def _dl(self, node, done):
        rows = []
        for c in node.children:
            if isinstance(c, Node) and c.tag in ("dt", "dd"):
                text = c.text().strip()
                rows.append(f"**{text}**\n" if c.tag == "dt" else f": {text}\n")
        return "\n" + "".join(rows) + "\n" if rows else ""

    def _table(self, node, done):
        inside = list(node.elements())
        rows = [[c for c in r.children if c.__class__ is Node and c.tag in ("td", "th")] for r in inside if r.tag == "tr"]
        rows = [r for r in rows if r]
        caption = next((n for n in inside if n.tag == "caption"), None)
        lead = f"\n\n{_fold(done.get(id(caption), ''))}" if caption is not None else ""
        if any(_SPANS.match(c.get(a)) for r in rows for c in r if c.attrs for a in ("colspan", "rowspan")):
            text = "\n".join(" ".join(_fold(done.get(id(c), "")).replace("\n", " ") for c in r) for r in rows).strip()
            return f"{lead}\n\n{text}\n\n" if text else ""
        cells = [[_fold(done.get(id(c), "")).replace("\n", " ").replace("|", "\\|") for c in r] for r in rows]
        if not any(map(any, cells)):
            return ""
        width = max(map(len, cells))
        cells = [r + [""] * (width - len(r)) for r in cells]
        line = lambda r: "| " + " | ".join(r) + " |"
        return f"{lead}\n\n" + "\n".join([line(cells[0]), line(["---"] * width), *map(line, cells[1:])]) + "\n\n"

    def _div(self, node, done):
        class_ = node.get("class")
        if "mermaid" in class_:
            return f"\n\n```mermaid\n{_raw_text(node).strip()}\n```\n\n"
        text = self.inner(node, done)
        if ADMONITION.search(class_) or node.get("role") == "alert" or ADMONITION_WORD.search(class_):
            kind = next((k for word, k in ALERTS if word in class_.lower()), None)
            body = _fold(text)
            return "\n\n" + (f"> [!{kind}]\n" if kind else "") + "\n".join(f"> {x}" for x in body.split("\n")) + "\n\n" if body else ""
        if "type" in class_:
            keyed = lambda x: bool(x.strip()) and ":" in x and not x.startswith(" ")
            lines = text.split("\n")
            out = [x + ("\n" if i + 1 < len(lines) and keyed(x) and keyed(lines[i + 1]) else "") for i, x in enumerate(lines)]
            text = "\n".join(out)
        return _block(text)

    def _section(self, node, done):
        spacer = "&nbsp;\n\n" if "tsd-member" in node.get("class") else ""
        text = self.inner(node, done).strip("\n")
        return f"\n\n{spacer}{text}\n\n" if text.strip() or spacer else ""

    def _details(self, node, done):
        return _block(self.inner(node, done))

    def _summary(self, node, done):
        text = self.inner(node, done).strip()
        return f"{text}\n\n"

    def _span(self, node, done):
        text = self.inner(node, done)
        return f"\n\n{text.strip()}\n\n" if node.get("data-as") == "p" else text


#: The elements with a rule of their own.
_RULES = {name[1:]: rule for name, rule in vars(Renderer).items() if name[0] == "_" and name[1] != "_" and name != "_list"}
_RULES |= dict.fromkeys(("td", "th", "li"), Renderer.inner)


def to_markdown(node: Node) -> str:
    return Renderer().render(node)

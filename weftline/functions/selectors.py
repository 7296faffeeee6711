"""CSS selectors: lists, the combinators of descendants, children and siblings, attribute tests, :not, :is and places among siblings.

``parse`` gives a list of chains; ``operators/twigs.py`` turns them into windows over the node table, ``matches_node``
answers for one element of a tree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from weftline.functions.dom import Node

PLACES = ("first-child", "last-child", "only-child")
_NAME = re.compile(r"-?[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff-]*|\*")
_ATTRIBUTE = re.compile(r"\[\s*([\w:.-]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s\"']+))\s*([iIsS])?\s*)?\]")
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")


@dataclass(frozen=True)
class Test:
    """One condition: kind ``attr`` (name, operator, value, any case), ``place`` (name), or ``not`` and ``is`` (chains)."""

    kind: str
    name: str = ""
    op: str = ""
    value: str = ""
    fold: bool = False
    chains: tuple = ()


@dataclass(frozen=True)
class Compound:
    tag: str | None = None
    tests: tuple[Test, ...] = ()


@dataclass(frozen=True)
class Chain:
    """Compounds from left to right; ``combinators[i]`` (one of " ", ">", "+", "~") stands before ``compounds[i + 1]``."""

    compounds: tuple[Compound, ...]
    combinators: tuple[str, ...] = field(default=())


class SelectorError(ValueError):
    """What is not a selector of this kind."""


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def take(self, pattern: re.Pattern) -> re.Match | None:
        m = pattern.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def fail(self) -> SelectorError:
        return SelectorError(f"not a selector at {self.at}: {self.text!r}")

    def chains(self, end: str) -> tuple[Chain, ...]:
        found = []
        while True:
            self.take(re.compile(r"\s*"))
            found.append(self.chain())
            self.take(re.compile(r"\s*"))
            if self.text[self.at : self.at + 1] == ",":
                self.at += 1
                continue
            if self.text[self.at : self.at + 1] != end:
                raise self.fail()
            self.at += len(end)
            return tuple(found)

    def chain(self) -> Chain:
        compounds, combinators = [self.compound()], []
        while True:
            before = self.at
            m = self.take(_COMBINATOR)
            if not m or self.text[self.at : self.at + 1] in ("", ",", ")"):
                if m and m[1]:
                    raise self.fail()
                self.at = before
                return Chain(tuple(compounds), tuple(combinators))
            combinators.append(m[1] or " ")
            compounds.append(self.compound())

    def compound(self) -> Compound:
        name, tests = self.take(_NAME), []
        while True:
            sign = self.text[self.at : self.at + 1]
            if sign == "[":
                m = self.take(_ATTRIBUTE)
                if not m:
                    raise self.fail()
                value = next((v for v in m.groups()[2:5] if v is not None), "")
                tests.append(Test("attr", m[1].lower(), m[2] or "", value, (m[6] or "").lower() == "i"))
            elif sign in ("#", "."):
                self.at += 1
                m = self.take(_NAME)
                if not m or m[0] == "*":
                    raise self.fail()
                tests.append(Test("attr", "id", "=", m[0]) if sign == "#" else Test("attr", "class", "~=", m[0]))
            elif sign == ":":
                self.at += 1
                m = self.take(_NAME)
                word = m[0].lower() if m else ""
                if word in ("not", "is", "where") and self.text[self.at : self.at + 1] == "(":
                    self.at += 1
                    tests.append(Test("not" if word == "not" else "is", chains=self.chains(")")))
                elif word in PLACES:
                    tests.append(Test("place", word))
                else:
                    raise self.fail()
            else:
                if not name and not tests:
                    raise self.fail()
                return Compound(None if not name or name[0] == "*" else name[0].lower(), tuple(tests))


@lru_cache(maxsize=512)
def parse(selector: str) -> tuple[Chain, ...]:
    """The chains of a selector list; an empty or unknown form is a SelectorError."""
    return _Reader(selector).chains("")


def _attribute(node: Node, t: Test) -> bool:
    if t.name not in node.attrs:
        return False
    have, want = node.attrs[t.name], t.value
    if t.fold:
        have, want = have.lower(), want.lower()
    if t.op in ("^=", "$=", "*=", "~=") and not want:
        return False
    return {
        "": lambda: True, "=": lambda: have == want, "~=": lambda: want in re.split(r"[ \t\n\r\f]+", have), "|=": lambda: have == want or have.startswith(want + "-"),
        "^=": lambda: have.startswith(want), "$=": lambda: have.endswith(want), "*=": lambda: want in have,
    }[t.op]()


def _elder(node: Node) -> list[Node]:
    """Element siblings before ``node``, nearest first."""
    siblings = [c for c in node.parent.children if isinstance(c, Node)] if node.parent else [node]
    at = next(i for i, c in enumerate(siblings) if c is node)
    return siblings[:at][::-1]


def _last(node: Node) -> bool:
    return node.parent is None or [c for c in node.parent.children if isinstance(c, Node)][-1] is node


def _fits(node: Node, compound: Compound) -> bool:
    def holds(t: Test) -> bool:
        if t.kind == "attr":
            return _attribute(node, t)
        if t.kind == "place":
            return (t.name == "last-child" or not _elder(node)) and (t.name == "first-child" or _last(node))
        return any(_reaches(node, c, len(c.compounds) - 1) for c in t.chains) == (t.kind == "is")

    return compound.tag in (None, node.tag) and all(holds(t) for t in compound.tests)


def _reaches(node: Node, chain: Chain, i: int) -> bool:
    if not _fits(node, chain.compounds[i]):
        return False
    if i == 0:
        return True
    over = [n for n in node.ancestors() if n.parent is not None]  # the root of the tree is no element
    near = {" ": over, ">": over[:1], "+": _elder(node)[:1], "~": _elder(node)}[chain.combinators[i - 1]]
    return any(_reaches(n, chain, i - 1) for n in near)


def matches_node(node: Node, selector: str) -> bool:
    """Whether an element of a tree fits a selector."""
    return any(_reaches(node, c, len(c.compounds) - 1) for c in parse(selector))

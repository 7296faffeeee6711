"""Selectors over the node table: every step of a twig is a window over a page's elements, no join of nodes with nodes.

Elements are dealt by page once. An element has a matching ancestor if the running maximum of the matching elements' ends
reaches it; its parent is the last element before it one level up; siblings are a window of their own. Chains of all
selectors advance together, so a round costs one window of each kind however many selectors there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from weftline.functions.selectors import Chain, Compound, Test, parse

SPACE = "[ \t\n\r\f]+"


def _ordered(*keys: str) -> WindowSpec:
    return W.partitionBy("page_id", *keys).orderBy("pre")


def _earlier(*keys: str) -> WindowSpec:
    return _ordered(*keys).rowsBetween(W.unboundedPreceding, -1)


def _attribute(t: Test) -> Column:
    have, want = F.element_at("attrs", t.name), F.lit(t.value.lower() if t.fold else t.value)
    have = F.lower(have) if t.fold else have
    if t.op in ("^=", "$=", "*=", "~=") and not t.value:
        return F.lit(False)
    found = {
        "": lambda: F.map_contains_key("attrs", t.name), "=": lambda: have == want, "~=": lambda: F.array_contains(F.split(have, SPACE), want),
        "|=": lambda: (have == want) | F.startswith(have, F.concat(want, F.lit("-"))), "^=": lambda: F.startswith(have, want), "$=": lambda: F.endswith(have, want), "*=": lambda: F.contains(have, want),
    }[t.op]()
    return F.coalesce(found, F.lit(False))


def _own(compound: Compound) -> Column:
    """What an element's tag and attributes alone decide of a compound."""
    tests = [_attribute(t) for t in compound.tests if t.kind == "attr"]
    if compound.tag:
        tests.append(F.coalesce(F.col("tag") == compound.tag, F.lit(False)))
    return reduce(and_, tests, F.lit(True))


def _place(name: str) -> Column:
    first, last = F.lag(F.lit(1)).over(_ordered("parent_id")).isNull(), F.lead(F.lit(1)).over(_ordered("parent_id")).isNull()
    return {"first-child": first, "last-child": last, "only-child": first & last}[name]


def _compounds(chains: tuple[Chain, ...]) -> Iterator[Compound]:
    """All compounds, those of inner lists before the outer ones."""
    for chain in chains:
        for c in chain.compounds:
            for t in c.tests:
                yield from _compounds(t.chains)
            yield c


def _lists(chains: tuple[Chain, ...], depth: int = 0) -> Iterator[tuple[int, tuple[Chain, ...]]]:
    for chain in chains:
        for t in (t for c in chain.compounds for t in c.tests if t.chains):
            yield depth + 1, t.chains
            yield from _lists(t.chains, depth + 1)


def _advanced(elements: DataFrame, wanted: Mapping[str, tuple[Chain, ...]], own: Mapping[Compound, str], inner: Mapping[tuple[Chain, ...], str]) -> DataFrame:
    """``elements`` with a column for each of ``wanted``: all chains go from left to right, a combinator at a time."""

    def fits(c: Compound) -> Column:
        nested = [F.col(inner[t.chains]) if t.kind == "is" else ~F.col(inner[t.chains]) for t in c.tests if t.chains]
        return reduce(and_, [*nested, *[F.col(f"_{t.name}") for t in c.tests if t.kind == "place"]], F.col(own[c]))

    chains = {f"_{name}_{i}": c for name, found in wanted.items() for i, c in enumerate(found)}
    out = elements.withColumns({column: fits(c.compounds[0]) for column, c in chains.items()})
    for step in range(1, max(len(c.compounds) for c in chains.values())):
        moving = {column: c for column, c in chains.items() if step < len(c.compounds)}
        children = [column for column, c in moving.items() if c.combinators[step - 1] == ">"]
        if children:  # each element stands at its own level for its children, and one level up for itself
            levels = F.explode(F.array(F.struct(F.col("depth").alias("level"), F.lit(True).alias("up")), F.struct((F.col("depth") - 1).alias("level"), F.lit(False).alias("up"))))
            both = out.withColumn("_at", levels).withColumn("_level", F.col("_at.level")).withColumn("_up", F.col("_at.up"))
            parents = {f"{column}_parent": F.coalesce(F.last(F.when(F.col("_up"), F.col(column)), ignorenulls=True).over(_earlier("_level")), F.lit(False)) for column in children}
            out = both.withColumns(parents).filter(~F.col("_up")).drop("_at", "_level", "_up")
        reached = {}
        for column, c in moving.items():
            m, combinator = F.col(column), c.combinators[step - 1]
            if combinator == " ":
                near = F.max(F.when(m, F.col("post"))).over(_earlier()) >= F.col("pre")
            elif combinator == "+":
                near = F.lag(m).over(_ordered("parent_id"))
            elif combinator == "~":
                near = F.max(m).over(_earlier("parent_id"))
            else:
                near = F.col(f"{column}_parent")
            reached[column] = F.coalesce(near, F.lit(False)) & fits(c.compounds[step])
        out = out.withColumns(reached).drop(*[f"{column}_parent" for column in children])
    every = {name: reduce(or_, [F.col(f"_{name}_{i}") for i in range(len(found))]) for name, found in wanted.items()}
    return out.withColumns(every).drop(*chains)


def mark(nodes: DataFrame, selectors: Mapping[str, str], parts: int | None = None) -> DataFrame:
    """(page_id, node_id, parent_id, pre, post, depth, tag, and a boolean for each of ``selectors``) of every element of a node table.

    Selectors are parsed by ``functions.selectors.parse``; what is none is a SelectorError before anything runs. A page_id
    stands for one page; elements of null page_ids are one page like any other. A page is handled in one task, which its
    byte limit bounds. Elements are dealt over ``parts`` partitions (by default the session's); a task sorts its share for
    each window, so their number has to grow with the table (``tables.shares``).
    """
    parsed = {name: parse(s) for name, s in selectors.items()}
    compounds = dict.fromkeys(c for found in parsed.values() for c in _compounds(found))
    own = {c: f"_own{i}" for i, c in enumerate(compounds)}
    depths: dict[tuple[Chain, ...], int] = {}
    for found in parsed.values():
        for depth, chains in _lists(found):
            depths[chains] = max(depth, depths.get(chains, 0))
    inner = {chains: f"inner{i}" for i, chains in enumerate(depths)}
    places = {t.name for c in compounds for t in c.tests if t.kind == "place"}
    narrow = ["page_id", "node_id", "parent_id", "pre", "post", "depth", "tag"]
    out = nodes.filter("kind = 'element'").select(*narrow, *[_own(c).alias(column) for c, column in own.items()]).repartition(*([parts] if parts else []), "page_id")
    if places:
        out = out.withColumns({f"_{p}": _place(p) for p in places})
    for depth in sorted(set(depths.values()), reverse=True):
        out = _advanced(out, {inner[chains]: chains for chains, d in depths.items() if d == depth}, own, inner)
    names = {f"wanted{i}": name for i, name in enumerate(parsed)}
    out = _advanced(out, {column: parsed[name] for column, name in names.items()}, own, inner)
    return out.select(*narrow, *[F.col(column).alias(name) for column, name in names.items()])


def counts(nodes: DataFrame, selectors: Mapping[str, str], parts: int | None = None) -> DataFrame:
    """(page_id, selector, n): how many elements of each page fit each selector; pages without elements have no rows."""
    marked = mark(nodes, {f"s{i}": s for i, s in enumerate(selectors.values())}, parts)
    n = marked.groupBy("page_id").agg(*[F.count_if(F.col(f"s{i}")).alias(f"s{i}") for i in range(len(selectors))])
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("selector"), F.col(f"s{i}").alias("n")) for i, name in enumerate(selectors)])).alias("x")
    return n.select("page_id", pairs).select("page_id", "x.selector", "x.n")

"""Selectors over trees and over node tables: hand-written cases, random twigs, and the structural join."""

import random
import time

import pytest
from pyspark.sql import functions as F

from weftline.config import NoiseConfig
from weftline.functions import noise
from weftline.functions.dom import Node, parse as tree
from weftline.functions.selectors import SelectorError, matches_node, parse
from weftline.operators import nodes, twigs
from weftline.sources import tables

PAGE = """<body><header id="top" class="site nav"><h1>T</h1></header><nav><ul><li class="first">a</li><li><a href="/x?Q=1" lang="en-GB">b</a></li><li>c</li></ul></nav>
<main><section data-kind="Lead"><p>1</p><p class="x y">2</p><div><p>3</p></div></section><p>4</p></main><footer><p>5</p></footer></body>"""
CASES = {
    "p": ["1", "2", "3", "4", "5"], "section p": ["1", "2", "3"], "section > p": ["1", "2"], "p + p": ["2"], "p ~ div p": ["3"], "section ~ p": ["4"],
    "main p:not(section p)": ["4"], "p.y.x": ["2"], "p:first-child": ["1", "3", "5"], "p:last-child": ["3", "4", "5"], "p:only-child": ["3", "5"],
    "[data-kind=Lead] > p": ["1", "2"], "[data-kind='lead' i] > p.x": ["2"], "[data-kind=lead]": [], "a[href^='/x'], li.first": ["a", "b"], "a[lang|=en]": ["b"], "a[lang|=e]": [],
    "a[href$='=1']": ["b"], "a[href*='']": [], "li:not(.first, :last-child)": ["b"], ":is(nav, footer) :is(p, li):not(:first-child)": ["b", "c"], "header#top > h1": ["T"], "body > main > p": ["4"],
    "ul li ~ li + li": ["c"], "nav li>a": ["b"], "*:not(*)": [],
}


def found(selector):
    return sorted(n.text().strip() for n in tree(PAGE).elements() if matches_node(n, selector))


@pytest.mark.parametrize("selector", CASES)
def test_selectors_on_a_tree(selector):
    assert found(selector) == CASES[selector]


def test_selectors_over_the_node_table(spark):
    table = nodes.html_nodes(spark.createDataFrame([(1, PAGE), (2, PAGE + "<p>6</p>"), (3, None)], "page_id long, html string"))
    n = {(r["page_id"], r["selector"]): r["n"] for r in twigs.counts(table, {s: s for s in CASES}).collect()}
    assert {s: n[1, s] for s in CASES} == {s: len(x) for s, x in CASES.items()}
    assert n[2, "p"] == 6 and {p for p, _ in n} == {1, 2}


@pytest.mark.parametrize("bad", ["", " ", "p >", "> p", "p,", "p:hover", "p[", "p[a=]", "a b)", ":not()", "..x", "p > > a"])
def test_what_is_no_selector(bad):
    with pytest.raises(SelectorError):
        parse(bad)


def random_page(r):
    def element(depth):
        tag = r.choice("div section span b".split())
        attrs = "".join(f' {a}="{r.choice(["x", "y", "x y", "xy"])}"' for a in ("class", "id", "k") if r.random() < 0.5)
        inner = "".join(element(depth + 1) if r.random() < 0.75 else "t" for _ in range(r.randint(0, 4 if depth < 5 else 0)))
        return f"<{tag}{attrs}>{inner}</{tag}>"

    return "".join(element(0) for _ in range(6))


def random_selector(r, depth=0):
    def compound():
        out = r.choice(["div", "section", "span", "b", "*", ""])
        for _ in range(r.randint(0, 2)):
            out += r.choice([".x", ".y", "#x", "[k]", "[k=xy]", "[k^=x]", "[k~=y]", ":first-child", ":last-child", ":only-child"])
            if depth < 2 and r.random() < 0.3:
                out += f":{r.choice(['not', 'is'])}({random_selector(r, depth + 1)})"
        return out or "div"

    chain = lambda: compound() + "".join(r.choice([" ", " > ", " + ", "~"]) + compound() for _ in range(r.randint(0, 3)))
    return ", ".join(chain() for _ in range(r.randint(1, 2)))


def test_random_twigs(spark):
    r = random.Random(11)
    pages = [(i, random_page(r)) for i in range(12)]
    selectors = [random_selector(r) for _ in range(40)]
    table = nodes.html_nodes(spark.createDataFrame(pages, "page_id long, html string"))
    marked = twigs.mark(table, {f"s{i}": s for i, s in enumerate(selectors)}).collect()
    got = {(m["page_id"], m["pre"]): [m[f"s{i}"] for i in range(len(selectors))] for m in marked}
    some = 0
    for page, html in pages:
        rows = [row for row in nodes.node_rows(html) if row[5] == "element"]
        for row, node in zip(rows, tree(html).elements(), strict=True):
            want = [matches_node(node, s) for s in selectors]
            assert got[page, row[2]] == want, (page, row, [s for s, a, b in zip(selectors, want, got[page, row[2]]) if a != b])
            some += sum(want)
    assert some > 500


def test_extra_selectors_of_the_noise_filter():
    config = NoiseConfig(extra_selectors=("section > .x", "not a selector(", "main > p"))
    root = noise.strip_noise(tree(PAGE), config)
    assert [n.text() for n in root.find_all("p") if n.parent.tag != "footer"] == ["1", "3"]


def test_structural_join(spark):
    r = random.Random(5)
    rows = []
    for page in (1, 2, None):
        rows += [(page, *n[:6]) for n in nodes.node_rows(random_page(r))]
    schema = "page_id long, node_id int, parent_id int, pre int, post int, depth int, kind string"
    n = spark.createDataFrame(rows, schema).repartition(3)
    roots = [x for x in rows if r.random() < 0.1] + [rows[3]] * 2
    inside = {x for x in rows if any(x[0] is not None and x[0] == y[0] and y[3] <= x[3] and x[4] <= y[4] for y in roots)}
    frame = spark.createDataFrame(roots, schema)
    assert sorted(map(tuple, nodes.within(n, frame).collect()), key=repr) == sorted(inside, key=repr)
    assert sorted(map(tuple, nodes.without(n, frame).collect()), key=repr) == sorted(set(rows) - inside, key=repr)
    assert nodes.within(n, frame.limit(0)).count() == 0 and nodes.without(n, frame.limit(0)).count() == len(rows)
    marked = nodes.covered(n, F.col("depth") == 1).filter("covered").collect()
    assert {tuple(x)[:-1] for x in marked} == {x for x in rows if x[0] is not None and x[5] >= 1}


def test_structural_join_is_linear(spark):
    n = spark.range(100_000).select(F.lit(1).cast("long").alias("page_id"), F.col("id").cast("int").alias("pre"), F.when(F.col("id") % 2 == 0, F.least(F.col("id") + 1, F.lit(99_999))).otherwise(F.col("id")).cast("int").alias("post"))
    nodes.within(n, n.filter("pre % 2 = 0")).count()
    began = time.time()
    assert nodes.within(n, n.filter("pre % 2 = 0")).count() == 100_000
    assert nodes.without(n, n.filter("pre % 4 = 0")).count() == 50_000
    assert time.time() - began < 5


def test_elements_are_dealt_by_the_tables_size(spark):
    rows = [(i, "<ul><li>a</li><li>b</li></ul>" + "x" * 971) for i in range(40)]
    p = spark.createDataFrame(rows, "page_id long, html string")
    assert [tables.shares(p, "html", each) for each in (1000, 2000, 10**6)] == [40, 20, 4]  # at least the session's 4
    n = nodes.html_nodes(p)
    assert twigs.mark(n, {"s": "ul > li"}, 9).rdd.getNumPartitions() == 9
    got = twigs.counts(n, {"s": "ul > li"}, 9).collect()
    assert sorted((r["page_id"], r["n"]) for r in got) == [(i, 2) for i in range(40)]

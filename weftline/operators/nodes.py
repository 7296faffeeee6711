"""Pages as a table of nodes with interval codes, so that questions about trees become joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftline.functions.dom import Node, parse
from weftline.functions.noise import element_score

SCHEMA = "page_id long, node_id int, parent_id int, pre int, post int, depth int, kind string, tag string, attrs map<string,string>, text string"
INVISIBLE = ("script", "style", "noscript")


def node_rows(html: str | None) -> list[tuple]:
    """(node_id, parent_id, pre, post, depth, kind, tag, attrs, text) in document order; a node's subtree is pre..post."""
    root = parse(html)
    out: list[list] = []
    stack: list[tuple[Node | str | int, int, int]] = [(c, -1, 0) for c in reversed(root.children)]
    while stack:
        item, parent, depth = stack.pop()
        if isinstance(item, int):
            out[item][3] = len(out) - 1
            continue
        i = len(out)
        if isinstance(item, str):
            out.append([i, parent, i, i, depth, "text", None, None, item])
            continue
        out.append([i, parent, i, i, depth, "element", item.tag, item.attrs, None])
        stack.append((i, parent, depth))
        stack += [(c, i, depth + 1) for c in reversed(item.children)]
    return [tuple(r) for r in out]


def html_nodes(pages: DataFrame) -> DataFrame:
    """The node table of ``pages`` (page_id, html); null or empty pages have no nodes."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                rows = [(p, *r) for p, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for r in node_rows(h)]
                kinds = [pa.int64(), *[pa.int32()] * 5, pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
                names = [f.split()[0] for f in SCHEMA.split(", ")]
                columns = [pa.array([list(r[i].items()) if i == 8 and r[i] is not None else r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, SCHEMA)


def attr(name: str) -> Column:
    return F.element_at("attrs", name)


def covered(nodes: DataFrame, roots: Column) -> DataFrame:
    """``nodes`` with ``covered``: whether a node is, or lies in the subtree of, one of the page's nodes that ``roots`` holds for.

    One pass over a page's nodes in document order: subtrees nest, so a node lies in one of the roots before it if the
    largest of their ends reaches it. A null page_id is no page, its nodes are not covered.
    """
    order = W.partitionBy("page_id").orderBy("pre").rowsBetween(W.unboundedPreceding, W.currentRow)
    reach = F.max(F.when(roots, F.col("post"))).over(order)
    return nodes.withColumn("covered", F.coalesce((reach >= F.col("pre")) & F.col("page_id").isNotNull(), F.lit(False)))


def _joined(nodes: DataFrame, roots: DataFrame, inside: bool) -> DataFrame:
    """``nodes`` inside or outside the subtrees of ``roots`` (page_id, pre, post): both sides merged in document order, roots first."""
    both = nodes.withColumn("_end", F.lit(None).cast(nodes.schema["post"].dataType)).unionByName(roots.select("page_id", "pre", F.col("post").alias("_end")), allowMissingColumns=True)
    order = W.partitionBy("page_id").orderBy("pre", F.col("_end").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = F.coalesce((F.max("_end").over(order) >= F.col("pre")) & F.col("page_id").isNotNull(), F.lit(False))
    merged = both.withColumn("_in", found).filter(F.col("_end").isNull())
    return merged.filter(F.col("_in") if inside else ~F.col("_in")).select(*[F.col(f"`{c}`") for c in nodes.columns])


def within(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes inside (or being) one of ``roots``, each once: a structural join by one merge, linear in both sides."""
    return _joined(nodes, roots, True)


def without(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes outside the subtrees of ``roots``."""
    return _joined(nodes, roots, False)


def primary_content(nodes: DataFrame) -> DataFrame:
    return covered(nodes, F.col("tag").isin("article", "main") | (attr("role") == "main")).filter("covered").drop("covered")


def visible_text(nodes: DataFrame) -> DataFrame:
    """(page_id, text): all text outside script, style and noscript, white space as one space."""
    seen = covered(nodes, F.col("tag").isin(*INVISIBLE)).filter("kind = 'text' AND NOT covered")
    joined = seen.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pre", "text"))).alias("t"))
    return joined.select("page_id", F.trim(F.regexp_replace(F.concat_ws("", F.transform("t", lambda x: x["text"])), r"\s+", " ")).alias("text"))


def tag_counts(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'element'").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def scores(nodes: DataFrame) -> DataFrame:
    """Element nodes with their noise ``score``."""
    return nodes.filter("kind = 'element'").withColumn("score", element_score(F.col("tag"), attr("class"), attr("id"), attr("role"), attr("style"), F.col("attrs"), F.lit(False)))

"""The page operator: HTML or raw bytes to Markdown rows, errors as values."""

from __future__ import annotations

import time
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from weftline.config import DEFAULT, MARKER, ExtractConfig
from weftline.functions import encoding, markdown, noise, urls
from weftline.functions.article import Article, content_root, extract_article, use_article
from weftline.functions.dom import Node, parse, parse_elements
from weftline.functions.metadata import FIELDS, early_metadata, extract_metadata, merge_metadata
from weftline.functions.render import to_markdown

METADATA = "struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">"
_ARROW_METADATA = pa.struct([(f, pa.string()) for f in FIELDS])
FOOTER = ("title", "author", "description")
_ARROW_FOOTER = pa.struct([(f, pa.string()) for f in FOOTER])


#: The stages of a page that takes a tree, in order.
STAGES = ("parse", "metadata", "article", "noise", "render", "cleanup", "links")
LAPS = "array<struct<stage:string,duration_ms:double>>"
_ARROW_LAPS = pa.list_(pa.struct([("stage", pa.string()), ("duration_ms", pa.float64())]))


class Laps:
    """The durations of one page's stages."""

    def __init__(self) -> None:
        self.at, self.laps = time.perf_counter(), []

    def lap(self, stage: str) -> None:
        now = time.perf_counter()
        self.laps.append({"stage": stage, "duration_ms": (now - self.at) * 1000})
        self.at = now


def html_to_markdown(html: str, url: str = "", config: ExtractConfig = DEFAULT) -> str:
    """One fragment or page: noise out, rendered, cleaned, links resolved."""
    root, every = parse_elements(html)
    text = _finish(_denoised(root, url, config, every), url, config, Laps())
    for node in every:  # without the ways up the tree is no circle, and goes without the collector
        node.parent = None
    return text


def _denoised(root: Node, url: str, config: ExtractConfig, every: list[Node] | None = None) -> Node:
    if not config.skip_noise:
        noise.strip_noise(root, config.noise, every)
        if url:
            noise.absolutise(root, url)
    if every is not None and not any(n.tag == "body" for n in every):
        return root
    return root.find("body") or root


def _finish(node: Node, url: str, config: ExtractConfig, laps: Laps) -> str:
    text = to_markdown(node)
    laps.lap("render")
    text = markdown.cleanup(text, config.cleanup)
    laps.lap("cleanup")
    text = markdown.resolve_links(text, url) if url else text
    laps.lap("links")
    return text


def footer_fields(found: dict, article: Article | None) -> dict:
    """What the footer says of a page: an article's own title and byline, else the title, author and description of its head."""
    if article is not None:
        return {"title": article.title, "author": article.byline, "description": None}
    return {k: found[k] for k in FOOTER}


def transform_page(html: str, url: str, truncated: bool = False, config: ExtractConfig = DEFAULT) -> dict:
    """markdown, title, metadata, content_source (article, root, body) and the stages' durations of one page.

    An article that keeps enough of the page is taken, else the first content root, else the whole cleaned body.
    """
    laps = Laps()
    root = parse(html)
    laps.lap("parse")
    found = extract_metadata(root, url)
    if truncated:
        found = merge_metadata(early_metadata(html, url), found)
    laps.lap("metadata")
    article = extract_article(root, found["title"])
    if article is not None and use_article(article, root):
        source, node = "article", article.node
    else:
        node = content_root(root)
        source = "root" if node is not None else "body"
    if source != "body":
        root = Node("body")
        root.children = [node]
        node.parent = root
    laps.lap("article")
    body = _denoised(root, url, config)
    laps.lap("noise")
    text = _finish(body, url, config, laps)
    title = found["title"]
    if title and not text.lstrip().startswith("# "):
        icon = f"![{urlsplit(url).hostname}]({found['favicon']}) " if found["favicon"] else ""
        text = f"# {icon}{title}\n\n{text}"
    if truncated:
        text = text if text.endswith(MARKER) else f"{text}\n\n{MARKER}"
    return {"markdown": text, "title": title, "metadata": found, "content_source": source, "footer": footer_fields(found, article if source == "article" else None), "stages": laps.laps}


#: The columns of a result row beside the page's own.
RESULT = ("final_url", "cache_key", "title", "metadata", "markdown", "content_size", "truncated", "content_source", "error")
#: Those of ``timed``.
TIMED = ("stages", "partition")


def transform_pages(pages: DataFrame, config: ExtractConfig = DEFAULT, fetched_at: str | None = None, timed: bool = False) -> DataFrame:
    """``pages`` (page_id, url, html) as result rows: url, final_url, cache_key, title, metadata, markdown, content_size, truncated, content_source, error.

    URL checks, size limits, classification of raw files, footers and keys are expressions; a tree is built once per page
    in one Arrow UDF, only for pages that need it. A page that fails gives an ``error`` and no markdown, never a failed job.
    ``fetched_at`` (a timestamp literal) dates the footer, so results repeat. A boolean column ``truncated`` of the input
    says that the fetch has cut the page, which the result repeats and the Markdown's marker shows. All other input columns
    pass, those with a result column's name give way. ``timed`` adds ``stages``, the durations of the stages that a page ran
    through (none for a raw file or a failure before its tree), and ``partition``, its task's (``operators/metrics.py``).
    """
    from weftline.operators.cache import cache_key
    from weftline.operators.results import failure

    html = F.col("html")
    named = {c.lower() for c in ("page_id", "url", "html", *RESULT, *(TIMED if timed else ()))}
    others = [c for c in pages.columns if c.lower() not in named]
    cut_before = F.coalesce(F.col("truncated").cast("boolean"), F.lit(False)) if "truncated" in {c.lower() for c in pages.columns} else F.lit(False)
    rest = F.struct(F.lit(None).cast("boolean").alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    rows = pages.select("page_id", "url", "html", cut_before.alias("_cut"), rest.alias("_rest"))
    # one column for each step: nested, every step would repeat the ones below it many times over
    rows = rows.withColumn("_u", urls.js_trim(F.col("url")))
    rows = rows.withColumn("_parts", urls.split_url(F.col("_u")))
    part = urls.parts_of(F.col("_parts"))
    rows = rows.withColumn("_host", urls.hostname(F.col("_u"), part))
    rows = rows.withColumn("_problem", urls.url_error(F.col("url"), config, part, F.col("_host")))
    rows = rows.withColumn("_problem", F.coalesce("_problem", F.when(html.isNull() | (html == ""), F.lit("Empty page")), F.when(encoding.has_binary_text(html), F.lit("binary_content_detected"))))
    rows = rows.withColumn("_target", urls.normalize_url(F.col("_u"), part))
    # a normal form's parts are the URL's own but for the host's spelling; only code hosts' pages are rewritten and split again
    rows = rows.withColumn("_platform", urls.raw_platform(F.col("_target"), part))
    rows = rows.withColumn("_file", F.when(F.col("_platform").isNotNull(), urls.to_raw_url(F.col("_target"), part, F.col("_platform"))))
    rows = rows.withColumn("_file_parts", urls.split_url(F.col("_file")))
    rows = rows.withColumn("_target", F.coalesce(F.when(F.col("_file").isNotNull(), urls.normalize_url(F.col("_file"), urls.parts_of(F.col("_file_parts")))), F.col("_target")))
    rows = rows.drop("_u", "_parts", "_host", "_platform", "_file", "_file_parts")
    rows = rows.withColumn("truncated", F.col("_cut") | F.coalesce(encoding.will_truncate(html, config.max_bytes), F.lit(False))).drop("_cut")
    rows = rows.withColumn("html", F.when(F.col("truncated"), encoding.truncate_html(html, config.max_bytes)).otherwise(html))
    rows = rows.withColumn("_raw", markdown.preserve_raw(F.col("_target"), F.col("html")))
    tree_html = F.when(F.col("_problem").isNull() & ~F.col("_raw"), F.col("html"))
    rows = rows.withColumn("_tree", tree_html)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            names = batch.schema.names
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                out = []
                for h, u, cut in zip(part.column("_tree").to_pylist(), part.column("_target").to_pylist(), part.column("truncated").to_pylist()):
                    if h is None:
                        out.append((None, None, None, None, None, None, []))
                        continue
                    try:
                        r = transform_page(h, u or "", bool(cut), config)
                        out.append((r["markdown"], r["title"], r["metadata"], r["content_source"], None, r["footer"], r["stages"]))
                    except Exception as e:  # a page's failure is a row
                        out.append((None, None, None, None, f"markdown_convert_failed: {type(e).__name__}", None, []))
                kinds = (pa.string(), pa.string(), _ARROW_METADATA, pa.string(), pa.string(), _ARROW_FOOTER)
                kinds += (_ARROW_LAPS,) if timed else ()
                new = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
                added = ["_md", "_title", "metadata", "_source", "_failed", "_foot"]
                if timed:
                    new.append(pa.array([TaskContext.get().partitionId()] * len(out), pa.int32()))
                    added += TIMED
                keep = [n for n in names if n != "_tree"]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in keep], *new], names=[*keep, *added])

    schema = f"page_id long, url string, html string, _rest boolean, _problem string, _target string, truncated boolean, _raw boolean, _md string, _title string, metadata {METADATA}, _source string, _failed string, _foot struct<{','.join(f + ':string' for f in FOOTER)}>" + (f", stages {LAPS}, partition int" if timed else "")
    fields = [T.StructField("_rest", rows.schema["_rest"].dataType) if f.name == "_rest" else f for f in T.StructType.fromDDL(schema)]
    done = rows.mapInArrow(run, T.StructType(fields))
    problem = F.coalesce("_problem", "_failed")
    raw = markdown.add_source(F.col("html"), F.col("_target"))
    body = F.when(F.col("_raw"), raw).otherwise(F.col("_md"))
    title = F.when(F.col("_raw"), markdown.raw_title(F.col("html"))).otherwise(F.col("_title"))
    when = F.lit(fetched_at).cast("timestamp")
    foot = markdown.footer(F.col("_foot.title"), F.col("_foot.author"), F.col("_target"), when, F.col("_foot.description"))
    full = F.when(F.col("_raw") | F.lit(not config.include_metadata), body).otherwise(markdown.with_footer(body, foot))
    return done.select(
        "page_id",
        "url",
        F.col("_target").alias("final_url"),
        F.when(problem.isNull(), cache_key(F.lit("markdown"), F.col("_target"))).alias("cache_key"),
        F.when(problem.isNull(), title).alias("title"),
        "metadata",
        F.when(problem.isNull(), full).alias("markdown"),
        F.when(problem.isNull(), F.length(full)).cast("long").alias("content_size"),
        (F.col("truncated") & problem.isNull()).alias("truncated"),
        F.when(problem.isNull(), F.when(F.col("_raw"), F.lit("raw")).otherwise(F.col("_source"))).alias("content_source"),
        failure(problem).alias("error"),
        *(TIMED if timed else ()),
        *[F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(others)],
    )


def transform_bodies(responses: DataFrame, config: ExtractConfig = DEFAULT) -> DataFrame:
    """Stored responses (page_id, url, status, content_type, content_encoding, body) as pages, with the first failing gate as ``error``.

    Gates in order: status, content coding, media type, size, binary signature; then the charset decides the decoding.
    """
    plain = encoding.is_uncoded(F.col("content_encoding"))  # such bodies stay out of Python
    coded = encoding.decode_content(F.when(~plain, F.col("body")), F.coalesce("content_encoding", F.lit("")))
    r = responses.withColumn("_d", coded).withColumn("_c", F.struct(F.when(plain, F.col("body")).otherwise(F.col("_d.body")).alias("body"), F.when(~plain, F.col("_d.error")).alias("error")))
    status = F.coalesce(F.col("status"), F.lit(200))
    cap, cut = encoding.cap_body(F.col("_c.body"), config.max_bytes)
    label = encoding.resolve_charset(F.col("_c.body"), F.coalesce("content_type", F.lit("")))
    error = (
        F.when(status == 429, F.lit("rate_limited"))
        .when(~status.between(200, 299), F.concat(F.lit("HTTP "), status.cast("string")))
        .when(F.col("_c.error").isNotNull(), F.col("_c.error"))
        .when(~encoding.media_type_allowed(F.coalesce("content_type", F.lit(""))), F.concat(F.lit("Unsupported content type: "), encoding.media_type(F.col("content_type"))))
        .when(encoding.is_binary(F.col("_c.body"), label), F.lit("Detailed content type check failed: binary content detected"))
    )
    return r.select("page_id", "url", F.when(error.isNull(), encoding.decoded(cap, label)).alias("html"), label.alias("encoding"), cut.alias("truncated"), F.octet_length("_c.body").alias("size"), error.alias("error"))

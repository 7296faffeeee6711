"""The operators as SQL functions of a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession, functions as F, types as T

from weftline.functions import codelang, encoding, markdown, metadata, noise, urls
from weftline.functions.article import extract_article
from weftline.functions.dom import parse
from weftline.functions.encoding import decode_html
from weftline.functions.render import to_html, to_markdown as rendered

NODE = "node_id int, parent_id int, pre int, post int, depth int, kind string, tag string, attrs map<string,string>, text string"


def _quoted(x: str) -> str:
    """A string as a SQL literal."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def code_language_sql(code: str) -> str:
    """``codelang.detect_code_language`` as SQL text."""
    hit = lambda lower, p: f"{f'lower({code})' if lower else code} RLIKE {_quoted(p)}"
    whens = " ".join(f"WHEN {' OR '.join(hit(*p) for p in patterns)} THEN '{name}'" for name, patterns in codelang.RULES)
    return f"CASE WHEN NOT {code} RLIKE {_quoted(chr(92) + 'S')} THEN NULL {whens} END"


def normalize_url_sql(url: str) -> str:
    """``urls.normalize_url`` as SQL text."""
    u = f"regexp_replace({url}, {_quoted(urls.TRIMMED)}, '')"
    part = lambda i: f"regexp_extract({u}, {_quoted(urls.PARTS)}, {i})"
    host = f"nullif(regexp_replace(lower({part(3)}), {_quoted(chr(92) + '.+$')}, ''), '')"
    port = f"CASE WHEN {part(4)} = '' OR lower({part(1)}) = 'http' AND {part(4)} = '80' OR lower({part(1)}) = 'https' AND {part(4)} = '443' THEN '' ELSE concat(':', {part(4)}) END"
    return f"concat(lower({part(1)}), '://', {host}, {port}, coalesce(nullif({part(5)}, ''), '/'), {part(6)}, {part(7)})"


def register(spark: SparkSession) -> None:
    """normalize_url, to_raw_url, is_blocked_ip, normalize_host, detect_encoding, decode_html, extract_metadata, extract_content, strip_noise, html_to_markdown, cleanup_markdown, detect_code_language, truncate_markdown, cache_key, safe_filename and the table function html_nodes.

    What one expression can say is a SQL function that Catalyst inlines; what needs a tree is an Arrow UDF.
    """
    from weftline.operators.nodes import node_rows
    from weftline.operators.pages import html_to_markdown

    text = T.StringType()

    @F.pandas_udf(text)
    def to_markdown(html: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else html_to_markdown(h, u or "") for h, u in zip(html, url)])

    @F.pandas_udf(text)
    def content(html: pd.Series) -> pd.Series:
        """The article as Markdown, null where the page has none."""

        def one(h: str) -> str | None:
            article = extract_article(parse(h))
            return None if article is None else markdown.cleanup(rendered(article.node))

        return html.map(one, na_action="ignore")

    @F.pandas_udf(text)
    def stripped(html: pd.Series) -> pd.Series:
        """The page's HTML without its noise."""

        def one(h: str) -> str:
            root = parse(h)
            noise.strip_noise(root)
            return to_html(root.find("body") or root)

        return html.map(one, na_action="ignore")

    @F.pandas_udf(text)
    def raw(url: pd.Series) -> pd.Series:
        return url.map(urls.raw_of, na_action="ignore")

    @F.pandas_udf(text)
    def charset(body: pd.Series, content_type: pd.Series) -> pd.Series:
        return pd.Series([encoding.charset_of(b, c) for b, c in zip(body, content_type)])

    @F.pandas_udf(text)
    def filename(url: pd.Series, title: pd.Series, hash_: pd.Series) -> pd.Series:
        from weftline.operators.cache import filename_of

        return pd.Series([filename_of(*x) for x in zip(url, title, hash_)])

    for name, f in {
        "to_raw_url": raw, "is_blocked_ip": urls.blocked_ip_udf, "normalize_host": urls.normalize_host, "detect_encoding": charset, "decode_html": decode_html, "extract_metadata": metadata.page_metadata, "extract_content": content,
        "strip_noise": stripped, "html_to_markdown": to_markdown, "cleanup_markdown": markdown.cleanup_markdown, "safe_filename": filename,
    }.items():
        spark.udf.register(name, f)
    for name, signature, body in (
        ("cache_key", "ns STRING, url STRING", "CASE WHEN ns <> '' AND url <> '' THEN concat(ns, ':', substring(sha2(url, 256), 1, 32)) END"),
        ("normalize_url", "url STRING", normalize_url_sql("url")),
        ("truncate_markdown", "value STRING, max_chars INT", markdown.truncate_sql("value", "max_chars")),
        ("detect_code_language", "code STRING", code_language_sql("code")),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({signature}) RETURNS STRING RETURN {body}")

    class HtmlNodes:
        def eval(self, html: str):
            yield from node_rows(html)

    spark.udtf.register("html_nodes", F.udtf(HtmlNodes, returnType=NODE))

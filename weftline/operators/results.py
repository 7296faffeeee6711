"""Shapes of results: error rows, structured content, blocks, stage metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.urls import redact_url


def error_row(message: Column, url: Column, status: Column, details: Column | None = None) -> Column:
    """JSON {error, url, statusCode?, details?}; absent parts are left out."""
    fields = [message.alias("error"), url.alias("url"), status.alias("statusCode")]
    return F.to_json(F.struct(*fields, *([details.alias("details")] if details is not None else [])))


# Codes of failures by the start of their message, and the HTTP status each maps to.
FAILURES = (
    ("rate_limited", "rate_limited", 429), ("unsupported_content_encoding", "unsupported_content_encoding", 415), ("binary_content_detected", "binary_content_detected", 415), ("Detailed content type check failed", "binary_content_detected", 500), ("markdown_convert_failed", "markdown_convert_failed", 500),
    ("Too many redirects", "FETCH_ERROR", 502), ("Redirect response missing", "EBADREDIRECT", 400), ("Unsupported content type", "FETCH_ERROR", 502), ("Network error", "FETCH_ERROR", 502), ("Request timeout", "ETIMEOUT", 504), ("DNS timeout", "ETIMEOUT", 504),
    ("Request was canceled", "ABORTED", 499), ("EBLOCKED", "EBLOCKED", 400), ("ENODATA", "ENODATA", 400), ("EINVAL", "EINVAL", 400), ("queue_full", "queue_full", 503),
    *((start, "VALIDATION_ERROR", 400) for start in ("URL ", "URLs ", "Invalid ", "Blocked ", "Empty page")),
)


def failure(message: Column) -> Column:
    """struct(code, status_code, message) of a failure's message; null for none. ``HTTP n`` keeps its status, what no other rule knows is a failed fetch."""
    status = F.regexp_extract(message, r"^HTTP (\d{3})", 1)
    code, number = F.when(status != "", F.concat(F.lit("HTTP_"), status)), F.when(status != "", status.try_cast("int"))
    for start, name, n in FAILURES:
        code, number = code.when(message.startswith(start), F.lit(name)), number.when(message.startswith(start), F.lit(n))
    return F.when(message.isNotNull(), F.struct(code.otherwise(F.lit("FETCH_ERROR")).alias("code"), number.otherwise(F.lit(502)).alias("status_code"), message.alias("message")))


def structured(results: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Result rows as one JSON column, without absent fields; empty strings count as absent. The columns ``keep`` stay beside it."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    body = F.struct("url", F.col("final_url").alias("resolvedUrl"), F.col("cache_key").alias("cacheKey"), some("title").alias("title"), F.col("markdown"), F.col("content_size").alias("contentSize"), F.when(F.col("truncated"), True).alias("truncated"))
    return results.select("page_id", F.to_json(body).alias("structured"), *keep)


def content_blocks(text: Column, uri: Column, title: Column, embed: bool) -> Column:
    """The blocks of an answer: its JSON text, the embedded file, a link to the stored one."""
    block = lambda kind, t, u: F.struct(F.lit(kind).alias("type"), t.alias("text"), u.alias("uri"), title.alias("name"))
    blocks = [block("text", text, F.lit(None).cast("string"))]
    blocks += [block("resource", text, uri)] if embed else []
    return F.array(*blocks, block("resource_link", F.lit(None).cast("string"), uri))


def stage_metrics(rows: DataFrame, budget_ms: int, warn_share: float = 0.5) -> DataFrame:
    """(stage, url without secrets, duration_ms, slow): a stage is slow over its share of the budget."""
    return rows.select("stage", redact_url(F.col("url")).alias("url"), "duration_ms", (F.col("duration_ms") > budget_ms * warn_share).alias("slow"))

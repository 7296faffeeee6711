"""Content-addressed cache as a table: keys, payloads, lookups, trimming, file names, listings."""

from __future__ import annotations

import hmac
import json
import re
import unicodedata

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftline.config import DEFAULT, MARKER
from weftline.functions.urls import js_trim, normalize_url

PAGE_EXTENSIONS = r"(?i)\.(?:html?|php|aspx?|jsp)$"


def cache_key(namespace: Column, url: Column, vary: Column | None = None) -> Column:
    """namespace:hash of the URL, and a hash of what else the content varies by; null for an empty part."""
    key = F.concat(namespace, F.lit(":"), F.substring(F.sha2(url, 256), 1, 32))
    if vary is not None:
        key = F.concat(key, F.when(vary.isNotNull(), F.concat(F.lit("."), F.substring(F.sha2(vary, 256), 1, 16))).otherwise(F.lit("")))
    return F.when((namespace != "") & (url != ""), key)


def key_namespace(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, r"^([^:]+):(.+)$", 1), F.lit(""))


def key_hash(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, r"(?s)^([^:]+):(.+)$", 2), F.lit(""))


def stable_json(value, depth: int = 0) -> str:
    """JSON with sorted keys at every level; deeper than 20 levels or cyclic is an error."""
    if depth > 20:
        raise ValueError("nested too deeply")
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{stable_json(value[k], depth + 1)}" for k in sorted(value)) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(stable_json(v, depth + 1) for v in value) + "]"
    return json.dumps(value, ensure_ascii=False)


def with_cache(requests: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], now: Column, by: Sequence[str] = ("cache_key",)) -> DataFrame:
    """Read-through: hits of ``lookup`` and, for the rest, what ``compute`` makes of the missing requests (their columns with content and fetched_at)."""
    found = lookup(requests, cache, now, by)
    made = compute(misses(requests, cache, now, by)).select(*requests.columns, "content", "fetched_at").withColumn("from_cache", F.lit(False))
    return found.filter("from_cache").select(*requests.columns, "content", "fetched_at", "from_cache").unionByName(made)


def _live(cache: DataFrame, now: Column, by: Sequence[str]) -> tuple[DataFrame, Column]:
    """Unexpired entries with ``by``, what tells entries apart, as _k0, _k1, ..., and the condition that a request is for one."""
    live = cache.filter(F.col("expires_at") > now).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "content", "fetched_at")
    return live, reduce(and_, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(by)])


def lookup(requests: DataFrame, cache: DataFrame, now: Column, by: Sequence[str] = ("cache_key",)) -> DataFrame:
    """Read-through: each request with its unexpired entry, if any, unless it forces a refresh."""
    live, same = _live(cache, now, by)
    out = requests.join(live, same, "left")
    hit = F.col("_k0").isNotNull() & ~F.coalesce(F.col("force_refresh"), F.lit(False))
    return out.withColumn("from_cache", hit).withColumn("content", F.when(hit, F.col("content"))).withColumn("fetched_at", F.when(hit, F.col("fetched_at"))).drop(*[f"_k{i}" for i in range(len(by))])


def misses(requests: DataFrame, cache: DataFrame, now: Column, by: Sequence[str] = ("cache_key",)) -> DataFrame:
    """Requests that must be computed."""
    live, same = _live(cache, now, by)
    forced = F.coalesce(F.col("force_refresh"), F.lit(False))
    return requests.join(live.drop("content", "fetched_at"), same & ~forced, "left_anti")


def put(cache: DataFrame, entries: DataFrame, by: Sequence[str] = ("cache_key",)) -> DataFrame:
    """The cache with ``entries`` inserted or replaced; of those equal in ``by``, what tells entries apart, the latest counts, empty content is skipped."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(entries.filter(F.coalesce(F.col("content"), F.lit("")) != "").withColumn("_new", F.lit(1)))
    latest = W.partitionBy(*by).orderBy(F.desc("_new"), F.desc("fetched_at"))
    return both.withColumn("_r", F.row_number().over(latest)).filter("_r = 1").drop("_r", "_new")


def with_aliases(entries: DataFrame) -> DataFrame:
    """Each entry under the key of its request and under that of its final URL."""
    alias = entries.filter(F.col("final_url").isNotNull() & (F.col("final_url") != F.col("url"))).withColumn("cache_key", cache_key(F.lit("markdown"), F.col("final_url")))
    return entries.unionByName(alias).dropDuplicates(["cache_key"])


def trim(cache: DataFrame, most_keys: int = DEFAULT.cache_keys, most_units: int = DEFAULT.cache_bytes) -> DataFrame:
    """The most recently used entries within both limits, per namespace: the window form of least-recently-used eviction.

    The rank comes first, so each task keeps ``most_keys`` rows of a namespace at most before anything is shuffled.
    """
    recent = W.partitionBy("namespace").orderBy(F.desc("last_access"), "cache_key")
    newest = cache.withColumn("recency", F.row_number().over(recent)).filter(F.col("recency") <= most_keys)
    return newest.withColumn("running_units", F.sum("content_units").over(recent.rowsBetween(W.unboundedPreceding, 0))).filter(F.col("running_units") <= most_units)


def payload(markdown: Column, title: Column, truncated: Column) -> Column:
    body = F.when(truncated & ~markdown.endswith(MARKER), F.concat(markdown, F.lit(MARKER))).otherwise(markdown)
    return F.to_json(F.struct(body.alias("markdown"), title.alias("title"), truncated.alias("truncated")))


def parse_payload(text: Column) -> Column:
    """struct(content, title, truncated) of a stored payload; null unless markdown or content is a string and the rest has its types."""
    v = F.try_parse_json(text)
    kind = lambda path: F.schema_of_variant(F.variant_get(v, path, "variant"))
    get = lambda path: F.try_variant_get(v, path, "string")
    ok = lambda path, name: F.coalesce(kind(path), F.lit(name)).isin(name, "VOID") | kind(path).isNull()
    is_text = lambda path: F.coalesce(kind(path) == "STRING", F.lit(False))
    cut = F.coalesce(F.try_variant_get(v, "$.truncated", "boolean"), F.lit(False))
    body = F.when(is_text("$.markdown"), get("$.markdown")).when(is_text("$.content"), get("$.content"))
    valid = (is_text("$.markdown") | is_text("$.content")) & ok("$.markdown", "STRING") & ok("$.content", "STRING") & ok("$.title", "STRING") & ok("$.truncated", "BOOLEAN")
    marked = F.when(cut & ~body.endswith(MARKER), F.concat(body, F.lit(MARKER))).otherwise(body)
    return F.when(valid, F.struct(marked.alias("content"), get("$.title").alias("title"), cut.alias("truncated")))


def safe_part(text: Column) -> Column:
    """Lower case, unsafe and control characters out, white space and runs of dashes as one dash, none at the ends."""
    x = F.regexp_replace(F.lower(text), r'[<>:"/\\|?*\p{C}]', "")
    x = F.regexp_replace(F.regexp_replace(x, r"\s+", "-"), "-+", "-")
    return F.nullif(F.regexp_replace(x, "^-|-$", ""), F.lit(""))


def safe_filename(url: Column, title: Column, hash_: Column, extension: str = ".md", now: Column | None = None) -> Column:
    """A file name from the URL's last segment without a page extension, else the title, else the hash, else the time (``now``, by default the query's); at most 200 characters with the extension."""
    path = F.regexp_extract(url, r"^(?i:https?)://[^/?#]*([^?#]*)", 1)
    base = F.regexp_extract(path, r"([^/]*)/*$", 1)
    base = safe_part(F.regexp_replace(base, PAGE_EXTENSIONS, ""))
    name = F.coalesce(F.when(base != "index", base), safe_part(title), F.substring(hash_, 1, 16), F.concat(F.lit("download-"), F.unix_millis(F.current_timestamp() if now is None else now)))
    return F.concat(F.substring(name, 1, 200 - len(extension)), F.lit(extension))


def filename_of(url: str | None, title: str | None, hash_: str | None, extension: str = ".md") -> str | None:
    """``safe_filename`` for one entry, for use inside UDFs."""

    def part(text: str | None) -> str:
        x = "".join(c for c in (text or "").lower() if c not in '<>:"/\\|?*' and not unicodedata.category(c).startswith("C"))
        return re.sub("^-|-$", "", re.sub("-+", "-", re.sub(r"\s+", "-", x)))

    m = re.match(r"(?i:https?)://[^/?#]*([^?#]*)", url or "")
    base = part(re.sub(PAGE_EXTENSIONS, "", (m[1] if m else "").rstrip("/").rsplit("/", 1)[-1]))
    name = (base if base != "index" else "") or part(title) or (hash_ or "")[:16]
    return name[: 200 - len(extension)] + extension


def resource_uri(namespace: Column, hash_: Column) -> Column:
    return F.when(namespace.rlike("^[A-Za-z0-9_-]{1,64}$") & hash_.rlike("(?i)^[a-f0-9.]{8,64}$"), F.concat(F.lit("internal://cache/"), F.url_encode(namespace), F.lit("/"), F.url_encode(hash_)))


def complete(values: DataFrame, column: str, prefix: str, most: int = 100, collation: str | None = None) -> DataFrame:
    """Distinct values with a prefix (any case), in order, at most ``most``: the completion list.

    With a ``collation`` (``UNICODE_CI``, ``UNICODE_CI_AI``, ``de_CI``, ...) prefix and distinctness are its own, of values
    that are equal in it the least in code points stands for all, and the order is its language's with case and accents.
    Values are combined before the one shuffle, by collation keys; nulls are no values.
    """
    if collation is None:
        return values.select(column).distinct().filter(F.lower(F.col(column)).startswith(prefix.lower())).orderBy(column).limit(most)
    if not re.fullmatch(r"[A-Za-z_]+", collation):
        raise ValueError("not the name of a collation")
    folded = F.collate(F.col(column), collation)
    full = re.sub(r"_(CI|AI)(?=_|$)", "", collation)
    found = values.filter(folded.startswith(F.collate(F.lit(prefix), collation)))
    one = found.groupBy(folded.alias("_folded")).agg(F.min(column).alias(column)).select(column)
    return one.orderBy(F.collate(F.col(column), full), column).limit(most)


def resource_parts(uri: Column) -> Column:
    """struct(namespace, hash) of a resource address, decoded; null unless both have the valid form."""
    pattern = r"^internal://cache/([^/]+)/([^/]+)$"
    part = lambda i: F.try_url_decode(F.regexp_extract(uri, pattern, i))
    ok = part(1).rlike("^[A-Za-z0-9_-]{1,64}$") & part(2).rlike("(?i)^[a-f0-9.]{8,64}$")
    return F.when(ok, F.struct(part(1).alias("namespace"), part(2).alias("hash")))


def resolve_parts(uri: Column, namespace: Column, hash_: Column) -> Column:
    """struct(namespace, hash) from template variables where both are valid, else from the address; null if neither is."""
    return F.coalesce(resource_parts(resource_uri(namespace, hash_)), resource_parts(uri))


def subscription_uri(uri: Column) -> Column:
    """The canonical spelling of a subscribed address: a cache address from its parts, another one with lower-case scheme; null if it is none."""
    scheme = F.regexp_extract(uri, r"^\s*([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)
    trimmed = js_trim(uri)
    plain = F.concat(F.lower(scheme), F.substring(trimmed, F.length(scheme) + 1, F.length(trimmed)))
    parts = resource_parts(plain)
    web = F.when(F.lower(scheme).isin("http", "https"), normalize_url(trimmed)).otherwise(plain)
    return F.when(scheme != "", F.coalesce(resource_uri(parts["namespace"], parts["hash"]), web))


def hmac_sha256(text: Column, key: bytes) -> Column:
    """HMAC-SHA-256 in hex. The key travels inside the function, so that no plan, event log or page of the UI shows it as a literal would be."""

    @F.pandas_udf("string")
    def mac(values: pd.Series) -> pd.Series:
        return values.map(lambda v: hmac.digest(key, v.encode(), "sha256").hex(), na_action="ignore")

    return mac(text)


def equal_texts(a: Column, b: Column) -> Column:
    """Equality of two texts by their digests, so that the comparison's time tells nothing of them."""
    return F.sha2(a, 256) == F.sha2(b, 256)


def listing(cache: DataFrame, now: Column) -> DataFrame:
    """What a listing of the cache shows: address, name, type of every live entry."""
    live = cache.filter(F.col("expires_at") > now)
    return live.select(resource_uri(key_namespace(F.col("cache_key")), key_hash(F.col("cache_key"))).alias("uri"), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url")).alias("name"), F.lit("text/markdown").alias("mime_type"))


def changes(before: DataFrame, after: DataFrame, by: Sequence[str] = ("cache_key",)) -> DataFrame:
    """Keys whose entry was added, removed or replaced: (cache_key, change, list_changed); the list changes unless an entry was only replaced.

    ``by`` names the columns that tell entries apart, where a key has several (its versions, say).
    """
    a = before.select(*by, F.col("content").alias("_a"), F.lit(True).alias("_had"))
    b = after.select(*by, F.col("content").alias("_b"), F.lit(True).alias("_has"))
    both = a.join(b, list(by), "full_outer").filter(F.col("_had").isNull() | F.col("_has").isNull() | ~F.col("_a").eqNullSafe(F.col("_b")))
    kind = F.when(F.col("_had").isNull(), "added").when(F.col("_has").isNull(), "removed").otherwise("replaced")
    return both.select("cache_key", kind.alias("change"), (kind != "replaced").alias("list_changed"))


def replay(ops: DataFrame, most_keys: int = DEFAULT.cache_keys, most_units: int = DEFAULT.cache_bytes, ttl_ms: int = DEFAULT.cache_ttl_seconds * 1000) -> DataFrame:
    """``ops`` (namespace, seq, op, key, units, ts_ms) with hit, evicted and size: the exact course of each namespace's cache.

    op is get or set. A get of an expired entry (at its time or later) drops it; a hit makes it the newest. A set of no or
    too many units does nothing; else the oldest entries go until the new one fits in both limits. A namespace's operations
    are folded in order as they stream by; what is held is at most ``most_keys`` entries. The order makes a namespace one
    task's work; ``trim`` is the form for a cache whose course does not matter.
    """
    dealt = ops.select("namespace", "seq", "op", "key", "units", "ts_ms").repartition("namespace").sortWithinPartitions("namespace", "seq")

    def run(stream):
        at, held, total = None, {}, 0
        for batch in stream:
            out = []
            for r in batch.itertuples(index=False):
                if r.namespace != at:
                    at, held, total = r.namespace, {}, 0
                hit, evicted = False, 0
                if r.op == "get" and r.key in held:
                    units, until = held.pop(r.key)
                    hit = r.ts_ms < until
                    if hit:
                        held[r.key] = (units, until)
                    else:
                        total -= units
                elif r.op == "set" and 0 < r.units <= most_units:
                    total -= held.pop(r.key, (0, 0))[0]
                    while held and (total + r.units > most_units or len(held) >= most_keys):
                        total -= held.pop(next(iter(held)))[0]
                        evicted += 1
                    held[r.key] = (int(r.units), int(r.ts_ms) + ttl_ms)
                    total += int(r.units)
                out.append((hit, evicted, len(held)))
            yield batch.assign(hit=[o[0] for o in out], evicted=[o[1] for o in out], size=[o[2] for o in out])

    return dealt.mapInPandas(run, "namespace string, seq long, op string, key string, units long, ts_ms long, hit boolean, evicted long, size long")

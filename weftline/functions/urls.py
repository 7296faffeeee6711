"""URL policy as Catalyst expressions: validation, canonical form, blocked networks, raw-content rewrites.

URLs are split by one regular expression, so every step is a built-in expression inside code generation. IPv6 literals
and IDNA names go through ``ip_key`` / ``normalize_host``, the only Arrow UDFs here.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable
from functools import reduce
from operator import or_
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from weftline.config import BLOCKED_HOSTS, BLOCKED_SUFFIXES, DEFAULT, ExtractConfig
from weftline.functions.addresses import NetworkIndex, address_bits, plain_address

#: scheme, user info, host, port, path, query, fragment
PARTS = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):/*(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$"

# Networks that pages may not point to (address, prefix length).
BLOCKED_NETWORKS_V4 = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "240.0.0.0/4")
BLOCKED_NETWORKS_V6 = ("::/128", "::1/128", "64:ff9b::/96", "64:ff9b:1::/48", "2001::/32", "2002::/16", "fc00::/7", "fe80::/10", "ff00::/8")
RAW_EXTENSIONS = (".md", ".markdown", ".txt", ".json", ".yaml", ".yml", ".toml", ".xml", ".csv", ".rst", ".adoc", ".org")
SKIP_PREFIXES = ("#", "javascript:", "mailto:", "tel:", "data:", "blob:")
#: White space at both ends, and the mark that some texts begin with.
TRIMMED = r"^[\s ﻿]+|[\s ﻿]+$"


#: A URL's parts by their number in PARTS.
Parts = Callable[[int], Column]
_SPLIT = "\u0001"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, PARTS, i)


def split_url(url: Column) -> Column:
    """All parts of a trimmed URL by one match, as an array of seven; what is no URL gives empty ones. Kept as a column of its own it saves every further function its own matches (``parts_of``)."""
    split = F.split(F.regexp_replace(url, PARTS, _SPLIT.join(f"${i}" for i in range(1, 8))), _SPLIT)
    return F.element_at(F.transform(F.array(split), lambda x: F.when(F.size(x) == 7, x).otherwise(F.array_repeat(F.lit(""), 7))), 1)


def parts_of(array: Column) -> Parts:
    return lambda i: F.get(array, F.lit(i - 1))


def js_trim(x: Column) -> Column:
    return F.regexp_replace(x, TRIMMED, "")


def hostname(url: Column, part: Parts | None = None) -> Column:
    """Lower case, without trailing dots; null for what has no host."""
    return F.nullif(F.regexp_replace(F.lower(part(3) if part else _part(url, 3)), r"\.+$", ""), F.lit(""))


def normalize_dns_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(js_trim(name)), r"\.+$", "")


def url_error(url: Column, config: ExtractConfig = DEFAULT, part: Parts | None = None, host: Column | None = None) -> Column:
    """The first failing check's message, or null. ``part`` and ``host`` are the URL's parts and host name, if they are known."""
    trimmed = js_trim(url)
    part = part or (lambda i: _part(trimmed, i))
    scheme = F.lower(part(1))
    host = hostname(trimmed, part) if host is None else host
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    suffix = F.lit(False)
    for s in BLOCKED_SUFFIXES:
        suffix = suffix | host.endswith(s)
    return (
        F.when(url.isNull() | (url == ""), F.lit("URL is required"))
        .when(trimmed == "", F.lit("URL cannot be empty"))
        .when(F.length(trimmed) > config.max_url_length, F.lit(f"URL exceeds maximum length of {config.max_url_length} characters"))
        .when(~trimmed.rlike(PARTS), F.lit("Invalid URL format"))
        .when(scheme.isin("http", "https") & host.isNull(), F.lit("Invalid URL format"))
        .when(~scheme.isin("http", "https"), F.concat(F.lit("Invalid protocol: "), scheme, F.lit(":. Only http: and https: are allowed")))
        .when(part(2) != "", F.lit("URLs with embedded credentials are not allowed"))
        .when(bare.isin(*BLOCKED_HOSTS), F.concat(F.lit("Blocked host: "), bare, F.lit(". Internal hosts are not allowed")))
        .when(is_blocked_ipv4(bare), F.concat(F.lit("Blocked IP range: "), bare, F.lit(". Private IPs are not allowed")))
        .when(suffix, F.concat(F.lit("Blocked hostname pattern: "), host, F.lit(". Internal domain suffixes are not allowed")))
    )


def normalize_url(url: Column, part: Parts | None = None) -> Column:
    """The canonical form of a valid http(s) URL: lower-case scheme and host, no trailing dots, no default port, a path."""
    u = js_trim(url)
    part = part or (lambda i: _part(u, i))
    scheme, port = F.lower(part(1)), part(4)
    keeps_port = (port != "") & ~(((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")))
    path = F.when(part(5) == "", F.lit("/")).otherwise(part(5))
    return F.concat(scheme, F.lit("://"), hostname(u, part), F.when(keeps_port, F.concat(F.lit(":"), port)).otherwise(F.lit("")), path, part(6), part(7))


def redact_url(url: Column) -> Column:
    """Without user, password, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([a-zA-Z][a-zA-Z0-9+.\-]*://)[^/@]*@", "$1")


def split_params(url: Column) -> Column:
    """struct(base, hash): origin and path, and the fragment with its sign (empty if there is nothing behind it); of a text that is no http URL what stands before the first ``?`` or ``#``, and all from the first ``#``."""
    u = js_trim(url)
    part = lambda i: _part(u, i)
    form = normalize_url(u, part)
    web = F.struct(F.regexp_extract(form, r"^([^?#]*)", 1).alias("base"), F.when(part(7) == "#", F.lit("")).otherwise(part(7)).alias("hash"))
    text = F.struct(F.regexp_extract(url, r"^([^?#]*)", 1).alias("base"), F.regexp_extract(url, r"(?s)(#.*)$", 1).alias("hash"))
    return F.when(F.lower(part(1)).isin("http", "https") & form.isNotNull(), web).otherwise(text)


# ---- addresses


def ipv4_number(ip: Column) -> Column:
    """A dotted quad as a number, else null."""
    quad = r"^(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)$"
    return F.when(ip.rlike(quad), F.aggregate(F.split(ip, r"\."), F.lit(0).cast("long"), lambda n, x: n * 256 + x.cast("long")))


def networks_v4() -> list[tuple[str, int, int]]:
    found = [ipaddress.ip_network(n) for n in BLOCKED_NETWORKS_V4]
    return [(str(n), int(n.network_address), int(n.broadcast_address)) for n in found]


def is_blocked_ipv4(ip: Column) -> Column:
    inside = lambda n: reduce(or_, (n.between(F.lit(low), F.lit(high)) for _, low, high in networks_v4()))
    return F.coalesce(F.exists(F.array(ipv4_number(ip)), inside), F.lit(False))


def normalize_ip(text: str | None) -> str | None:
    """Trimmed, lower case, without zone; an IPv4-mapped IPv6 address as IPv4."""
    if text is None:
        return None
    value = text.strip().lower().split("%", 1)[0]
    if value.startswith("[") and value.endswith("]"):
        value = value[1:-1]
    try:
        ip = ipaddress.ip_address(value)
    except ValueError:
        return value
    if isinstance(ip, ipaddress.IPv6Address) and ip.ipv4_mapped is not None:
        return str(ip.ipv4_mapped)
    return str(ip)


_V4 = [ipaddress.ip_network(n) for n in BLOCKED_NETWORKS_V4]
_V6 = [ipaddress.ip_network(n) for n in BLOCKED_NETWORKS_V6]


def blocked_address(text: str | None) -> bool:
    value = normalize_ip(text)
    if not value:
        return False
    if value in BLOCKED_HOSTS:
        return True
    try:
        ip = ipaddress.ip_address(value)
    except ValueError:
        return False
    return any(ip in n for n in (_V4 if ip.version == 4 else _V6))


def is_blocked_ip(ip: Column) -> Column:
    """``blocked_address`` as an expression: the literal hosts, and a search in the interval index of all blocked networks."""
    named = [h for h in BLOCKED_HOSTS if not re.fullmatch(r"[0-9a-f:.]*[0-9:][0-9a-f:.]*", h)]
    addressed = [h for h in BLOCKED_HOSTS if h not in named]
    index = NetworkIndex.of([*BLOCKED_NETWORKS_V4, *BLOCKED_NETWORKS_V6, *addressed])
    return F.coalesce(plain_address(ip).isin(*named), F.lit(False)) | index.holds(address_bits(ip))


@F.pandas_udf(T.BooleanType())
def blocked_ip_udf(ip: pd.Series) -> pd.Series:
    """The same for SQL texts, where a function has to have a name."""
    return ip.map(blocked_address, na_action=None).astype(bool)


def host_of(value: str | None) -> str | None:
    """A Host header's or setting's host: first item of a list, no port, no brackets, ASCII."""
    if value is None:
        return None
    first = value.split(",")[0].strip().lower()
    if not first:
        return None
    if "://" in first:
        first = urlsplit(first).netloc.rpartition("@")[2]
    bracket = re.match(r"^\[([^\]]+)\](?::\d+)?$", first)
    if bracket:
        return bracket[1]
    if first.count(":") > 1:
        try:
            return str(ipaddress.ip_address(first))
        except ValueError:
            return None
    name = first.rpartition(":")[0] if re.search(r":\d+$", first) else first
    name = name.rstrip(".")
    try:
        return name.encode("idna").decode() if not name.isascii() else name or None
    except UnicodeError:
        return None


@F.pandas_udf(T.StringType())
def normalize_host(value: pd.Series) -> pd.Series:
    return value.map(host_of, na_action="ignore")


# ---- raw content of code hosts


def _http(url: Column) -> Column:
    return F.lower(_part(url, 1)).isin("http", "https")


def is_raw_url(url: Column) -> Column:
    low = F.lower(url)
    return low.contains("raw.githubusercontent.com") | low.contains("gist.githubusercontent.com") | low.contains("/-/raw/") | low.rlike(r"bitbucket\.org/[^/]+/[^/]+/raw/")


_GITHUB = r"^(?:/)([^/]+)/([^/]+)/blob/([^/]+)/(.+)$"
_GIST = r"^/([^/]+)/([^/]+)$"
_GIST_RAW = r"^/([^/]+)/([^/]+)/raw/(.+)$"
_GITLAB = r"^(/.+)/-/blob/([^/]+)/(.+)$"
_BITBUCKET = r"^/([^/]+)/([^/]+)/src/([^/]+)/(.+)$"


def raw_platform(url: Column, part: Parts | None = None) -> Column:
    """github-gist, github, gitlab or bitbucket for a page that has a raw form, else null."""
    part = part or (lambda i: _part(url, i))
    path, host = part(5), F.lower(part(3))
    gist = (host == "gist.github.com") & (path.rlike(_GIST) | path.rlike(_GIST_RAW))
    return (
        F.when(url.isNull() | (url == "") | is_raw_url(url) | ~F.lower(part(1)).isin("http", "https"), F.lit(None).cast("string"))
        .when(gist, "github-gist")
        .when(host.rlike(r"^(?:[^.]+\.)?github\.com$") & path.rlike(_GITHUB), "github")
        .when(host.rlike(r"^(?:.*\.)?gitlab\.com$") & path.rlike(_GITLAB), "gitlab")
        .when(host.rlike(r"^(?:[^.]+\.)?bitbucket\.org$") & path.rlike(_BITBUCKET), "bitbucket")
    )


def to_raw_url(url: Column, part: Parts | None = None, platform: Column | None = None) -> Column:
    """The URL of the raw file behind a code host's page; other URLs as they are. ``part`` and ``platform`` are those of the URL, if they are known."""
    part = part or (lambda i: _part(url, i))
    path, platform = part(5), raw_platform(url, part) if platform is None else platform
    file = F.regexp_extract(part(7), r"^#file-(.+)$", 1)
    gist_file = F.when(path.rlike(_GIST_RAW), F.concat(F.lit("/"), F.regexp_extract(path, _GIST_RAW, 3))).when(file != "", F.concat(F.lit("/"), F.replace(file, F.lit("-"), F.lit(".")))).otherwise(F.lit(""))
    gist_user = F.when(path.rlike(_GIST_RAW), F.regexp_extract(path, _GIST_RAW, 1)).otherwise(F.regexp_extract(path, _GIST, 1))
    gist_id = F.when(path.rlike(_GIST_RAW), F.regexp_extract(path, _GIST_RAW, 2)).otherwise(F.regexp_extract(path, _GIST, 2))
    origin = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(3)))
    return (
        F.when(platform == "github-gist", F.concat(F.lit("https://gist.githubusercontent.com/"), gist_user, F.lit("/"), gist_id, F.lit("/raw"), gist_file))
        .when(platform == "github", F.concat(F.lit("https://raw.githubusercontent.com"), F.regexp_replace(path, _GITHUB, "/$1/$2/$3/$4")))
        .when(platform == "gitlab", F.concat(origin, F.regexp_replace(path, _GITLAB, "$1/-/raw/$2/$3")))
        .when(platform == "bitbucket", F.concat(origin, F.regexp_replace(path, _BITBUCKET, "/$1/$2/raw/$3/$4")))
        .otherwise(url)
    )


def raw_of(url: str) -> str:
    """``to_raw_url`` for one address, for use inside UDFs."""
    m = re.match(PARTS, url)
    low = url.lower()
    if not m or m[1].lower() not in ("http", "https") or any(x in low for x in ("raw.githubusercontent.com", "gist.githubusercontent.com", "/-/raw/")) or re.search(r"bitbucket\.org/[^/]+/[^/]+/raw/", low):
        return url
    host, path = m[3].lower(), m[5]
    if host == "gist.github.com":
        file = re.match(r"#file-(.+)$", m[7] or "")
        deep = re.match(_GIST_RAW, path)
        page = re.match(_GIST, path)
        if deep or page:
            user, gist = (deep or page)[1], (deep or page)[2]
            return f"https://gist.githubusercontent.com/{user}/{gist}/raw" + (f"/{deep[3]}" if deep else "/" + file[1].replace("-", ".") if file else "")
    for hosts, pattern, form in (
        (r"(?:[^.]+\.)?github\.com$", _GITHUB, r"https://raw.githubusercontent.com/\1/\2/\3/\4"),
        (r"(?:.*\.)?gitlab\.com$", _GITLAB, rf"{m[1].lower()}://{host}\1/-/raw/\2/\3"),
        (r"(?:[^.]+\.)?bitbucket\.org$", _BITBUCKET, rf"{m[1].lower()}://{host}/\1/\2/raw/\3/\4"),
    ):
        if re.match(hosts, host) and re.match(pattern, path):
            return re.sub(pattern, form, path)
    return url


def is_raw_text_url(url: Column) -> Column:
    """Already raw, or the path ends in one of RAW_EXTENSIONS (from its last dot on)."""
    base = F.lower(F.regexp_extract(url, r"^([^?#]*)", 1))
    return is_raw_url(url) | F.regexp_extract(base, r"(\.[^.]*)$", 1).isin(*RAW_EXTENSIONS)


# ---- references


def resolve_href(href: str, base: str) -> str:
    """Markdown link target: kept if empty, spaced, absolute or special; else joined to ``base``."""
    target = href.strip()
    if not target or re.search(r"[\t\n\f\r ]", target):
        return href
    if target.startswith("#") or re.match(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:", target):
        return target
    return absolute(target, base)


def absolute(target: str, base: str) -> str:
    try:
        return urljoin(base, target.strip())
    except ValueError:
        return target


def image_alt(src: Column) -> Column:
    """Words of an image's file name: last path segment without its extension, runs of _ and - as spaces."""
    absolute_ = src.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:")
    path = F.regexp_extract(F.when(absolute_, _part(src, 5)).otherwise(F.regexp_extract(src, r"^([^?#]*)", 1)), r"([^/]*)$", 1)
    name = F.regexp_replace(path, r"^(.+)\.[^.]*$", "$1")
    return F.when(absolute_ & ~_http(src), F.lit("")).otherwise(F.trim(F.regexp_replace(name, "[_-]+", " ")))


def alt_of(src: str) -> str:
    m = re.match(r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", src)
    if m and m[1].lower() not in ("http", "https"):
        return ""
    name = urlsplit(src).path.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return re.sub(r"[_-]+", " ", name[:dot] if dot > 0 else name).strip()


def first_srcset(srcset: Column) -> Column:
    return F.element_at(F.split(js_trim(F.split_part(srcset, F.lit(","), F.lit(1))), r"\s+"), 1)

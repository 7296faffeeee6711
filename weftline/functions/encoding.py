"""Bytes to text: charsets, binary detection, media types, size limits."""

from __future__ import annotations

import codecs
import re
import zlib

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from weftline.config import DEFAULT

# Byte order marks (the longer ones first) and signatures of binary formats, in hex.
BOMS = (("FFFE0000", "utf-32le"), ("0000FEFF", "utf-32be"), ("EFBBBF", "utf-8"), ("FFFE", "utf-16le"), ("FEFF", "utf-16be"))
BINARY_SIGNATURES = (
    "25504446 89504E47 47494638 FFD8FF 52494646 424D 49492A00 4D4D002A 00000100 504B0304 1F8B 425A68 52617221 377ABCAF 7F454C46 4D5A CFFAEDFE 0061736D "
    "1A45DFA3 66747970 464C56 494433 FFFB FFFA 4F676753 664C6143 4D546864 774F4646 00010000 4F54544F 53514C69"
).split()
TEXTUAL_TYPES = (
    "application/json application/ld+json application/xml application/xhtml+xml application/javascript application/ecmascript application/x-javascript "
    "application/x-yaml application/yaml application/markdown"
).split()
TEXTUAL_SUFFIXES = ("+json", "+xml", "+yaml", "+text", "+markdown")


def starts_with(body: Column, hexes: str) -> Column:
    return F.hex(F.substring(body, 1, len(hexes) // 2)) == hexes


def header_charset(content_type: Column) -> Column:
    """charset of a Content-Type value, unquoted; null if there is none."""
    value = F.regexp_extract(content_type, r"(?i)charset\s*=\s*([^;]+)", 1)
    return F.nullif(F.trim(F.regexp_replace(F.trim(value), '^["\']|["\']$', "")), F.lit(""))


def bom_charset(body: Column) -> Column:
    out = None
    for signature, name in BOMS:
        out = F.when(starts_with(body, signature), F.lit(name)) if out is None else out.when(starts_with(body, signature), F.lit(name))
    return out


def declared_charset(body: Column) -> Column:
    """What the first 8192 bytes declare: a charset attribute, else an XML encoding; lower case."""
    head = F.decode(F.substring(body, 1, 8192), "ISO-8859-1")
    html = F.regexp_extract(head, r"""(?i)charset\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>;/]+))""", 0)
    xml = F.regexp_extract(head, r"""(?i)<\?xml[^>]*encoding\s*=\s*(?:"([^"]*)"|'([^']*)')""", 0)
    value = lambda x: F.nullif(F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, r"(?is)^.*=\s*", ""), "[\"']", ""))), F.lit(""))
    return F.coalesce(value(html), value(xml))


def resolve_charset(body: Column, content_type: Column) -> Column:
    return F.coalesce(bom_charset(body), F.lower(header_charset(content_type)), declared_charset(body), F.lit("utf-8"))


def charset_of(body: bytes | None, content_type: str | None) -> str:
    """``resolve_charset`` for one body, for use inside UDFs."""
    body = body or b""
    for signature, name in BOMS:
        if body.startswith(bytes.fromhex(signature)):
            return name
    header = re.search(r"(?i)charset\s*=\s*([^;]+)", content_type or "")
    named = re.sub("^[\"']|[\"']$", "", header[1].strip()).strip().lower() if header else ""
    head = body[:8192].decode("latin-1")
    for pattern in (r"""(?i)charset\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>;/]+))""", r"""(?i)<\?xml[^>]*encoding\s*=\s*(?:"([^"]*)"|'([^']*)')"""):
        m = None if named else re.search(pattern, head)
        named = named or (next((g for g in m.groups() if g), "").strip().lower() if m else "")
    return named or "utf-8"


def decode_bytes(body: bytes | None, label: str | None) -> str | None:
    if body is None:
        return None
    try:
        name = codecs.lookup((label or "utf-8").strip().lower().replace("utf-16", "utf-16-le") if (label or "").strip().lower() == "utf-16" else (label or "utf-8").strip().lower()).name
    except LookupError:
        name = "utf-8"
    if name in ("iso8859-1", "latin-1", "ascii"):
        name = "cp1252"
    text = body.decode(name, "replace")
    return text[1:] if text[:1] == "﻿" else text


@F.pandas_udf(T.StringType())
def decode_html(body: pd.Series, label: pd.Series) -> pd.Series:
    return pd.Series([decode_bytes(b, x) for b, x in zip(body, label)])


def decoded(body: Column, label: Column) -> Column:
    """``decode_html``; valid UTF-8 that is labelled so never leaves the JVM, so that Python holds only the other bodies of a batch."""
    text = F.when(starts_with(body, "EFBBBF"), F.substring(body, 4, 2**31 - 1)).otherwise(body).cast("string")
    plain = F.coalesce(F.lower(F.trim(label)), F.lit("")).isin("", "utf-8", "utf8") & F.coalesce(F.is_valid_utf8(text), F.lit(True))
    return F.when(plain, text).otherwise(decode_html(F.when(~plain, body), label))


def is_wide(label: Column) -> Column:
    x = F.coalesce(F.lower(F.trim(label)), F.lit(""))
    return x.startswith("utf-16") | x.startswith("utf-32") | x.isin("ucs-2", "unicodefffe", "unicodefeff")


def has_binary_signature(body: Column) -> Column:
    hit = F.lit(False)
    for s in BINARY_SIGNATURES:
        hit = hit | starts_with(body, s)
    return hit


def has_nul(body: Column, limit: int = 1000) -> Column:
    return F.hex(F.substring(body, 1, limit)).rlike("^(?:..)*?00")


def is_binary(body: Column, label: Column) -> Column:
    wide = is_wide(label)
    return F.when(wide, F.lit(False)).otherwise(has_binary_signature(body) | has_nul(body))


def has_binary_text(text: Column) -> Column:
    """A NUL, or more than a tenth of U+FFFD in the first 2000 characters."""
    sample = F.substring(text, 1, 2000)
    return text.contains("\x00") | (F.regexp_count(sample, F.lit("�")) > F.length(sample) * F.lit(0.1))


def media_type(content_type: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))), F.lit(""))


def is_text_like(kind: Column) -> Column:
    hit = kind.startswith("text/") | kind.isin(*TEXTUAL_TYPES)
    for s in TEXTUAL_SUFFIXES:
        hit = hit | kind.endswith(s)
    return hit


def media_type_allowed(content_type: Column) -> Column:
    kind = media_type(content_type)
    return kind.isNull() | is_text_like(kind)


def retry_after(header: Column, now: Column) -> Column:
    """Seconds: a leading number, else the distance to an HTTP date, never below 0; else 60."""
    number = F.regexp_extract(header, r"^\s*(\d+)", 1).try_cast("long")
    when = F.try_to_timestamp(F.regexp_extract(header, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    wait = F.when(when.isNotNull(), F.greatest(F.ceil((F.unix_millis(when) - F.unix_millis(now)) / 1000), F.lit(0)))
    return F.coalesce(number, wait.cast("long"), F.lit(60).cast("long"))


def _inflate(body: bytes, limit: int) -> bytes:
    """At most ``limit`` bytes (0: all) of a gzip or deflate body; a bomb is never blown up."""
    for window in (47, -15):  # gzip or zlib by its header, else raw
        coder = zlib.decompressobj(window)
        try:
            out = coder.decompress(body, limit)
        except zlib.error:
            continue
        if not coder.eof and not (limit and len(out) >= limit):
            raise EOFError
        while coder.unused_data[:2] == b"\x1f\x8b" and not (limit and len(out) >= limit):  # further gzip members
            rest, coder = coder.unused_data, zlib.decompressobj(window)
            out += coder.decompress(rest, limit - len(out) if limit else 0)
        return out
    raise zlib.error


def content_decode(body: bytes | None, codings: str | None, limit: int = DEFAULT.max_bytes + 1) -> tuple[bytes | None, str | None]:
    """Undoes stacked content codings, last first, up to ``limit`` bytes each: (body, error). What does not decode passes as it is."""
    if body is None or not codings:
        return body, None
    names = [c.strip().lower() for c in codings.split(",") if c.strip()]
    for name in names:
        if name not in ("gzip", "x-gzip", "deflate", "br", "identity"):
            return None, "unsupported_content_encoding"
    out = body
    for name in reversed(names):
        try:
            if name in ("gzip", "x-gzip", "deflate"):
                out = _inflate(out, limit)
            elif name == "br":
                return None, "unsupported_content_encoding"
        except (OSError, EOFError, zlib.error):
            return body, None
    return out, None


@F.pandas_udf(T.StructType([T.StructField("body", T.BinaryType()), T.StructField("error", T.StringType())]))
def decode_content(body: pd.Series, codings: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([content_decode(b, c) for b, c in zip(body, codings)], columns=["body", "error"])


def is_uncoded(codings: Column) -> Column:
    """Whether a Content-Encoding names no coding but identity."""
    return F.coalesce(codings, F.lit("")).rlike(r"(?i)^[\s,]*(?:identity\s*(?:,[\s,]*|$))*$")


def cap_body(body: Column, limit: int) -> tuple[Column, Column]:
    """(first ``limit`` bytes, truncated); 0 or less is no limit."""
    if limit <= 0:
        return body, F.lit(False)
    return F.substring(body, 1, limit), F.octet_length(body) > limit


def drop_dangling_tag(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]*$", "")


def will_truncate(html: Column, limit: int | Column = DEFAULT.max_bytes) -> Column:
    return F.octet_length(html) > limit


def truncate_html(html: Column, limit: int | Column = DEFAULT.max_bytes, already: Column | None = None) -> Column:
    """At most ``limit`` bytes of UTF-8, cut at a character, without an unfinished tag where something was cut."""
    limit = limit if isinstance(limit, Column) else F.lit(max(0, limit))
    raw = F.encode(html, "UTF-8")
    byte = lambda back: F.conv(F.hex(F.substring(raw, limit - back + 1, F.lit(1))), 16, 10).cast("int")
    inside = lambda back: F.coalesce(byte(back).between(0x80, 0xBF), F.lit(False))
    # the byte after the cut is inside a character: its first byte is one to three before
    back = F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
    cut = F.decode(F.substring(raw, F.lit(1), limit - back), "UTF-8")
    trimmed = F.when(already, drop_dangling_tag(html)).otherwise(html) if already is not None else html
    return F.when(F.octet_length(html) <= limit, trimmed).otherwise(drop_dangling_tag(cut))

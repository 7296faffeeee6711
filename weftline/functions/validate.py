"""Checks on finished Markdown, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Structure flags and the line pattern that shows each.
STRUCTURE = {
    "headings": r"(?m)^#{1,6}\s+\S",
    "code_blocks": r"(?m)^```",
    "links": r"\[[^\]]+\]\([^)]+\)",
    "lists": r"(?m)^\s*[-*+]\s+\S",
    "numbered_lists": r"(?m)^\s*\d+\.\s+\S",
    "images": r"!\[[^\]]*\]\([^)]+\)",
    "tables": r"(?m)^\|.*\|",
    "blockquotes": r"(?m)^>\s",
}


def has_texts(text: Column, expected: list[str], ignore_case: bool = False) -> Column:
    """All expected texts occur; one written /pattern/ or /pattern/i is a regular expression."""
    found = F.lit(True)
    for e in expected:
        if e.startswith("/") and e.rfind("/") > 0:
            pattern, flags = e[1 : e.rfind("/")], e[e.rfind("/") + 1 :]
            found = found & text.rlike(("(?i)" if "i" in flags or ignore_case else "") + pattern)
        else:
            found = found & (F.lower(text).contains(e.lower()) if ignore_case else text.contains(e))
    return found


def code_blocks(text: Column) -> Column:
    return F.floor(F.regexp_count(text, F.lit(r"(?m)^\s*```")) / 2).cast("long")


def code_block_check(text: Column, least: int, shown: int = 3, preview: int = 100) -> Column:
    """struct(n_blocks, enough, languages, previews): the fenced blocks, whether they are ``least`` at least, and of the first ``shown`` the language (or none) and the beginning."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```.*?```"), F.lit(0))
    first = F.slice(blocks, 1, shown)
    language = lambda b: F.coalesce(F.nullif(F.regexp_extract(b, r"^```(\w+)", 1), F.lit("")), F.lit("none"))
    begin = lambda b: F.concat(F.substring(b, 1, preview), F.when(F.length(b) > preview, F.lit("...")).otherwise(F.lit("")))
    n = F.size(blocks)
    return F.struct(n.cast("long").alias("n_blocks"), (n >= least).alias("enough"), F.transform(first, language).alias("languages"), F.transform(first, begin).alias("previews"))


def structure(text: Column) -> dict[str, Column]:
    return {name: text.rlike(p) for name, p in STRUCTURE.items()}


def similarity(text: Column, reference: Column) -> Column:
    """Share of the reference's distinct trimmed lines that the text has."""
    lines = lambda x: F.array_distinct(F.filter(F.transform(F.split(x, "\n"), lambda v: F.trim(v)), lambda v: v != ""))
    n = F.size(lines(reference))
    return F.when(n > 0, F.size(F.array_intersect(lines(text), lines(reference))) / n)

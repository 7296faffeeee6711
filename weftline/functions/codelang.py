"""Language of code blocks as one CASE: matchers in order of weight, so the first that holds is the heaviest."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Words and patterns by which a language is told, heaviest first.
BASH_COMMANDS = "sudo chmod mkdir cd ls cat echo".split()
BASH_MANAGERS = "npm yarn pnpm npx brew apt pip cargo go".split()
BASH_VERBS = "install add run build start".split()
TYPE_HINTS = "string number boolean void any unknown never".split()
HTML_STARTS = "<!doctype <html <head <body <div <span <p <a <script <style".split()
_BASH_LINE = rf"^\s*(?:#!|\$ |# |(?:{'|'.join(BASH_COMMANDS)})(?: |$)|(?:{'|'.join(BASH_MANAGERS)}) (?:{'|'.join(BASH_VERBS)})(?: |$))"
_CSS_LINE = r"^\s*(?:[.#][^\n]*\{|[a-z][\w-]*\s*:[^(\n]*;[^(\n]*$)"
_YAML_LINE = r"^[^\S\n]*[^:\s\n][^:\n]*:[ \t]+\S"

#: (language, on lower-cased text?, patterns of which one must be found, pattern that must not)
RULES: tuple[tuple[str, tuple[tuple[bool, str], ...]], ...] = (
    ("rust", ((True, r"let mut"), (True, r"\b(?:fn|impl|struct|enum)\b"), (True, r"(?s)^(?=.*use )(?=.*::)"))),
    ("go", ((True, 'import "'), (True, r"\b(?:package|func)\b"))),
    ("jsx", ((True, r"""classname=|jsx:|from 'react'|from "react\""""), (False, "<[A-Z]"))),
    ("typescript", ((True, r"\b(?:interface|type)\b"), (True, rf": ?(?:{'|'.join(TYPE_HINTS)})"))),
    ("sql", ((True, r"\b(?:select|insert|update|delete|create|alter|drop)\b"),)),
    ("python", (
        (True, r"print\(|__name__|self\.|elif "), (False, "None|True|False"), (True, r"(?m)\b(?:def |elif |except |finally:|yield |lambda |raise |pass$)"),
        (True, r"(?s)^(?=.*\b(?:import|from|class)\b)(?!.*\b(?:const |let |var |function |require\(|=>|===|!==|console\.))(?!.*\{)(?!.*from ')"),
    )),
    ("css", ((True, "@media|@import|@keyframes"), (False, rf"(?m){_CSS_LINE}"))),
    ("bash", ((False, rf"(?m){_BASH_LINE}"),)),
    ("yaml", ((False, rf"(?m){_YAML_LINE}"),)),
    ("javascript", ((True, r"\b(?:const|let|var|function|class|async|await|export|import)\b"),)),
    ("html", ((True, "|".join(re.escape(t) for t in HTML_STARTS)),)),
    ("json", ((False, r"^\s*[{\[]"),)),
)


def detect_code_language(code: Column) -> Column:
    """The language, null for blank or unknown code."""
    low = F.lower(code)
    out = F.when(~code.rlike(r"\S"), F.lit(None).cast("string"))
    for name, patterns in RULES:
        hit = F.lit(False)
        for lower, p in patterns:
            hit = hit | (low if lower else code).rlike(p)
        out = out.when(hit, F.lit(name))
    return out


_COMPILED = [(name, [(lower, re.compile(p)) for lower, p in patterns]) for name, patterns in RULES]


def language_of(code: str) -> str | None:
    """The same for one text, for use inside UDFs."""
    if not code.strip():
        return None
    low = code.lower()
    return next((name for name, patterns in _COMPILED if any(p.search(low if lower else code) for lower, p in patterns)), None)


def language_from_attributes(class_name: str | None, data_language: str | None) -> str | None:
    tokens = (class_name or "").split()
    for t in tokens:
        m = re.match(r"(?i)(?:language-|lang-|highlight-)(.*)$", t)
        if m:
            return m[1]
    if "hljs" in tokens:
        other = next((t for t in tokens if t.lower() != "hljs" and not t.lower().startswith("hljs-")), None)
        if other:
            return other
    value = (data_language or "").strip()
    return value if re.fullmatch(r"[A-Za-z0-9_]+", value) else None


def attribute_language(class_name: Column, data_language: Column) -> Column:
    """As ``language_from_attributes``, as an expression."""
    tokens = F.filter(F.split(F.coalesce(class_name, F.lit("")), r"\s+"), lambda t: t != "")
    prefixed = F.get(F.filter(tokens, lambda t: F.lower(t).rlike("^(?:language-|lang-|highlight-)")), F.lit(0))
    other = F.get(F.filter(tokens, lambda t: (F.lower(t) != "hljs") & ~F.lower(t).startswith("hljs-")), F.lit(0))
    value = F.trim(data_language)
    return F.coalesce(
        F.regexp_replace(prefixed, "(?i)^(?:language-|lang-|highlight-)", ""),
        F.when(F.array_contains(tokens, "hljs"), other),
        F.when(value.rlike("^[A-Za-z0-9_]+$"), value),
    )

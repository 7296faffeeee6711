"""The subpackage's queries and the SQL of those that SQL can express."""

from __future__ import annotations

from . import collocations, decontamination, html_text, language, lines, manifest, mixing, near_duplicates, quality, substrings, suffixes, token_counts, topk


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_suffixes": suffixes.op2_suffixes,
        "op3_topk": topk.op3_topk,
        "op4_near_duplicates": near_duplicates.op4_near_duplicates,
        "op5_substrings": substrings.op5_substrings,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_quality": quality.op7_quality,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_language": language.op9_language,
        "op10_main_text": html_text.op10_main_text,
        "op11_lines": lines.op11_lines,
        "op12_manifest": manifest.op12_manifest,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.OP1_SQL,
        "op2_suffixes": suffixes.OP2_SQL,
        "op3_topk": topk.OP3_SQL,
        "op4_near_duplicates": near_duplicates.OP4_SQL,
        "op11_lines": lines.OP11_SQL,
        "op12_manifest": manifest.OP12_SQL,
        "op13_collocations": collocations.OP13_SQL,
    }

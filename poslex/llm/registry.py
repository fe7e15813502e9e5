"""The subpackage's queries, by the name they are registered under."""

from __future__ import annotations

from . import html_template, language_id, line_dedup, minhash_dedup, mixing, packing, pii, quality_rules, syncmers, token_orc

_MODULES = {
    "op1_line_dedup": line_dedup,
    "op2_mixing": mixing,
    "op3_pii": pii,
    "op4_quality_rules": quality_rules,
    "op5_language_id": language_id,
    "op6_packing": packing,
    "op7_syncmers": syncmers,
    "op8_minhash_dedup": minhash_dedup,
    "op9_token_orc": token_orc,
    "op10_html_template": html_template,
}


def queries() -> dict:
    return {name: m.query for name, m in _MODULES.items()} | {"op7_passages": syncmers.passages_query}


def oracle_sql() -> dict:
    return {name: m.oracle() for name, m in _MODULES.items() if hasattr(m, "oracle")}

"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from tidemark.llm.language_id import op1_language_id
from tidemark.llm import html_content, importance, lexical, media, mixing, near_dedup, packing, pii, secret_scan, substring_dedup, top_k
from tidemark.llm.sharding import op7_sharding


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_mixing": mixing.op2_mixing,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_media": media.op4_media,
        "op5_top_k": top_k.op5_top_k,
        "op6_packing": packing.op6_packing,
        "op7_sharding": op7_sharding,
        "op8_html": html_content.op8_html,
        "op9_pii": pii.op9_pii,
        "op10_substring_dedup": substring_dedup.op10_substring_dedup,
        "op11_importance": importance.op11_importance,
        "op12_secrets": secret_scan.op12_secrets,
        "op13_lexical": lexical.op13_lexical,
    }


def oracle_sql() -> dict[str, str]:
    """Only what SQL can express over whole tables; the rest is tested by brute force."""
    return {"op5_top_k": top_k.ORACLE, "op11_importance": importance.ORACLE, "op13_lexical": lexical.ORACLE}

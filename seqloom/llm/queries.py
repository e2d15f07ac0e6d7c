"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import bpe, filter_audit, html, langid, lm, mixing, negatives, quality, simhash, spotsigs, suffix, token_counts, topk


def queries() -> dict:
    return {
        "op1_topk_search": topk.query,
        "op2_source_mix": mixing.query,
        "op3_simhash_neardup": simhash.query,
        "op4_html_extract": html.query,
        "op5_spotsigs": spotsigs.query,
        "op6_langid_bigru": langid.query,
        "op7_ctw_lm": lm.query,
        "op8_suffix_dedup": suffix.query,
        "op9_bpe": bpe.query,
        "op10_quality_gam": quality.query,
        "op11_token_counts": token_counts.query,
        "op12_filter_audit": filter_audit.query,
        "op13_hard_negatives": negatives.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": topk.ORACLE, "op12_filter_audit": filter_audit.ORACLE, "op13_hard_negatives": negatives.ORACLE}

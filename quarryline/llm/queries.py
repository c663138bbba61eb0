"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, html_main, importance, infill, lm, mixing, pieces, quality, setjoin, simhash, substring, topk, warc


def queries() -> dict:
    return {
        "op1_sentencepiece": pieces.op1_sentencepiece,
        "op2_warc_derivatives": warc.op2_warc_derivatives,
        "op3_simhash_near_duplicates": simhash.op3_simhash_near_duplicates,
        "op4_exact_top_k": topk.op4_exact_top_k,
        "op5_html_main_text": html_main.op5_html_main_text,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_mix_sources": mixing.op7_mix_sources,
        "op8_substring_dedup": substring.op8_substring_dedup,
        "op9_lm_scores": lm.op9_lm_scores,
        "op10_chat_perspectives": chat.op10_chat_perspectives,
        "op11_jaccard_join": setjoin.op11_jaccard_join,
        "op12_fill_in_middle": infill.op12_fill_in_middle,
        "op13_importance_resampling": importance.op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_derivatives": warc.WARC_SQL,
        "op4_exact_top_k": topk.TOPK_SQL,
        "op7_mix_sources": mixing.MIX_SQL,
        "op10_chat_perspectives": chat.CHAT_SQL,
        "op11_jaccard_join": setjoin.JACCARD_SQL,
        "op12_fill_in_middle": infill.INFILL_SQL,
        "op13_importance_resampling": importance.IMPORTANCE_SQL,
    }

"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from strandloom.llm import audit, chat, codes, decontamination, embeddings, html, jaccard, language, mixing, quality, rules, sharding, substrings


def queries() -> dict:
    return {
        "op1_embedding_near_dedup": embeddings.op1_embedding_near_dedup,
        "op2_benchmark_decontamination": decontamination.op2_benchmark_decontamination,
        "op3_substring_dedup": substrings.op3_substring_dedup,
        "op4_ngram_jaccard_join": jaccard.op4_ngram_jaccard_join,
        "op5_language_id": language.op5_language_id,
        "op6_balanced_sharding": sharding.op6_balanced_sharding,
        "op7_chat_formatting": chat.op7_chat_formatting,
        "op8_html_extraction": html.op8_html_extraction,
        "op9_quality_classifier": quality.op9_quality_classifier,
        "op10_source_mixing": mixing.op10_source_mixing,
        "op11_filter_audit": audit.op11_filter_audit,
        "op12_vector_codes": codes.op12_vector_codes,
        "op13_quality_rules": rules.op13_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_source_mixing": mixing.OP10_SQL, "op11_filter_audit": audit.OP11_SQL, "op12_vector_codes": codes.OP12_SQL}

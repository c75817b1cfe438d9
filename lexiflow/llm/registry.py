"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat_format, importance, jaccard_join, language_id, merkle, mixing, quality_rules, spelling, suffix_dedup, token_files, toxicity, va_search

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_chat_format": chat_format.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_jaccard_join": jaccard_join.query,
    "op5_source_mix": mixing.query,
    "op6_bpe": bpe.query,
    "op7_toxicity": toxicity.query,
    "op8_token_files": token_files.query,
    "op9_importance_resampling": importance.query,
    "op10_va_search": va_search.query,
    "op11_merkle": merkle.query,
    "op12_language_id": language_id.query,
    "op13_spelling": spelling.query,
}

ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op2_chat_format": chat_format.ORACLE,
    "op3_suffix_dedup": suffix_dedup.ORACLE,
    "op4_jaccard_join": jaccard_join.ORACLE,
    "op10_va_search": va_search.ORACLE,
    "op11_merkle": merkle.ORACLE,
    "op13_spelling": spelling.ORACLE,
}

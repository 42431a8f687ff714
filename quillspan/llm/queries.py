"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from quillspan.llm import bpe, conversations, decontaminate, importance, line_dedup, quality, sharding, simhash, substring_dedup, topk_search, toxicity, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_simhash": simhash.op2_simhash,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_shard": sharding.op4_shard,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_bpe_roundtrip": bpe.op6_bpe_roundtrip,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_token_counts": bpe.op8_token_counts,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_exact_topk": topk_search.op10_exact_topk,
    "op11_importance_resample": importance.op11_importance_resample,
    "op12_quality": quality.op12_quality,
    "op13_repair_conversations": conversations.op13_repair_conversations,
}

ORACLES = {
    "op5_url_filter": url_filter.ORACLE,
    "op10_exact_topk": topk_search.ORACLE,
}

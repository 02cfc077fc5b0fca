"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from mixloom.llm import bpe, decontaminate, jaccard_join, line_dedup, lm_score, quality, repeats, token_counts, toxicity, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_lm_scoring": lm_score.op5_lm_scoring,
    "op6_ngram_jaccard": jaccard_join.op6_ngram_jaccard,
    "op7_suffix_dedup": repeats.op7_suffix_dedup,
    "op8_url_filters": url_filter.op8_url_filters,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLES = {"op1_line_dedup": line_dedup.ORACLE, "op4_decontamination": decontaminate.ORACLE, "op6_ngram_jaccard": jaccard_join.ORACLE}

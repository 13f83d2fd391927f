"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from screenlake.llm import filter_audit, hard_negatives, html_text, near_text, near_vectors, packing, pieces, quality, sharding, suffix_dedup, toxicity, url_rules, word_bpe

QUERIES = {
    "op1_piece_sampling": pieces.query,
    "op2_quality_forest": quality.query,
    "op3_cap_filters": near_vectors.query,
    "op4_hilbert_shards": sharding.query,
    "op5_html_text": html_text.query,
    "op6_toxicity_ordinal": toxicity.query,
    "op7_minhash_dedup": near_text.query,
    "op8_best_fit": packing.query,
    "op9_url_rules": url_rules.query,
    "op10_suffix_dedup": suffix_dedup.query,
    "op11_filter_audit": filter_audit.query,
    "op12_word_bpe": word_bpe.query,
    "op13_hard_negatives": hard_negatives.query,
}

ORACLES = {
    "op3_cap_filters": near_vectors.ORACLE,
    "op7_minhash_dedup": near_text.ORACLE,
    "op9_url_rules": url_rules.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}

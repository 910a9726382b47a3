"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from probity.llm import ann, bpe, decontaminate, licenses, lines, ngram_lm, quality, sharding, simhash, url_filter

QUERIES = {
    "op1_quality_pairwise": quality.op1_quality_pairwise,
    "op2_bpe_roundtrip": bpe.op2_bpe_roundtrip,
    "op3_url_rules": url_filter.op3_url_rules,
    "op4_bounded_ring": sharding.op4_bounded_ring,
    "op5_license_rules": licenses.op5_license_rules,
    "op6_block_matrix_knn": ann.op6_block_matrix_knn,
    "op7_greedy_tiling": decontaminate.op7_greedy_tiling,
    "op8_template_lines": lines.op8_template_lines,
    "op9_simhash_components": simhash.op9_simhash_components,
    "op10_stupid_backoff": ngram_lm.op10_stupid_backoff,
}
ORACLE_SQL = {
    "op3_url_rules": url_filter.ORACLE_SQL,
    "op6_block_matrix_knn": ann.ORACLE_SQL,
    "op10_stupid_backoff": ngram_lm.ORACLE_SQL,
}

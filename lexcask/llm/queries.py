"""The queries of this subpackage and, where SQL can express one, the same in DuckDB's SQL."""

from __future__ import annotations

from . import chat_format, hamming_search, hard_negatives, kd_clusters, near_dedup, packing, path_dedup, pieces, quality, secret_scan, sql, suffix_dedup, token_counts, url_trust

QUERIES = {
    "op1_url_trust": url_trust.op1,
    "op2_path_dedup": path_dedup.op2,
    "op3_packing": packing.op3,
    "op4_secret_scan": secret_scan.op4,
    "op5_token_counts": token_counts.op5,
    "op6_quality_rules": quality.op6,
    "op7_hamming_search": hamming_search.op7,
    "op8_suffix_dedup": suffix_dedup.op8,
    "op9_near_dedup": near_dedup.op9,
    "op10_pieces": pieces.op10,
    "op11_chat_format": chat_format.op11,
    "op12_hard_negatives": hard_negatives.op12,
    "op13_kd_clusters": kd_clusters.op13,
}

ORACLES: dict[str, str] = {
    "op1_url_trust": url_trust.verdict_sql(),
    "op2_path_dedup": sql.PATH_DEDUP,
    "op6_quality_rules": quality.kept_sql(),
    "op8_suffix_dedup": sql.SUFFIX_DEDUP,
    "op9_near_dedup": sql.NEAR_DEDUP,
    "op11_chat_format": chat_format.formatted_sql(),
    "op12_hard_negatives": hard_negatives.negatives_sql(),
    "op13_kd_clusters": kd_clusters.clusters_sql(),
}

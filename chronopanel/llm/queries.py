"""Queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import bpe, centroids, chat, compact_windows, decontaminate, media, nearest, quality, sharding, simhash, spelling, suffix_array, url_filter

QUERIES = {
    "op1_byte_level_bpe": bpe.op1_byte_level_bpe,
    "op2_label_propagation_shards": sharding.op2_label_propagation_shards,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_substring_dedup": compact_windows.op4_substring_dedup,
    "op5_media_columns": media.op5_media_columns,
    "op6_url_filters": url_filter.op6_url_filters,
    "op7_suffix_array_dedup": suffix_array.op7_suffix_array_dedup,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_centroid_clustering": centroids.op12_centroid_clustering,
    "op13_nearest_neighbours": nearest.op13_nearest_neighbours,
}

ORACLE_SQL: dict[str, str] = {
    "op6_url_filters": url_filter.OP6_SQL,
    "op10_chat_formatting": chat.OP10_SQL,
    "op12_centroid_clustering": centroids.OP12_SQL,
    "op13_nearest_neighbours": nearest.OP13_SQL,
}

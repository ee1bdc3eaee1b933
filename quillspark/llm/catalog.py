"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Module of each query; queries() imports them all, so that a broken one is seen.
_QUERIES = {
    "op1_sentencepiece": "piece_tokens",
    "op2_substring_dedup": "substring_dedup",
    "op3_license_scan": "license_scan",
    "op4_language_id": "language_id",
    "op5_quality_rules": "quality_rules",
    "op6_secret_scan": "secret_scan",
    "op7_suffix_array_dedup": "repeats",
    "op8_near_dedup": "near_dedup",
    "op9_packing": "packing",
    "op10_vector_search": "vector_search",
    "op11_ranked_search": "ranked_search",
    "op12_kd_shards": "kd_shards",
    "op13_token_alignment": "token_alignment",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in dict.fromkeys(_QUERIES.values()) for name, sql in getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", {}).items()}

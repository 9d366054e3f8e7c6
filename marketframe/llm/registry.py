"""All queries of this package and the SQL of those that DuckDB can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ["op01_chat_tree", "op02_substring_dedup", "op03_url_filter", "op04_source_mix", "op05_retrieval_packing", "op06_embedding_dedup", "op07_near_dup",
           "op08_weighted_fingerprint", "op09_main_text", "op10_language_id",
           "op11_license_scan", "op12_spelling_forms", "op13_prefix_trie"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"marketframe.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

"""Operators for preparing language-model training data. Nothing else in the library imports this package."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES and ORACLE_SQL, in the order of their numbers.
MODULES = ["line_dedup", "url_filter", "topk_search", "ngram_join", "packing", "token_tables", "language_id", "decontaminate", "html_extract", "license_scan", "secret_scan", "centroid_clusters", "prefix_trie"]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").ORACLE_SQL.items()}

"""The registered queries of the library: name -> job over the tables of a folder, and the same in SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES and ORACLE_SQL.
MODULES: list[str] = ["engagement_queries", "content_queries", "ranking_queries", "parts_queries", "stream_queries", "library_queries", "table_queries", "supplier_queries"]
FLAGSHIP = "engagement_open_rate_rank"


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"millrace.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"millrace.plans.{m}").ORACLE_SQL.items()}

"""Registered queries of the document engine and their DuckDB equivalents."""

from __future__ import annotations

from . import io_queries, service_queries, structure_queries, text_queries

_MODULES = (text_queries, structure_queries, io_queries, service_queries)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}

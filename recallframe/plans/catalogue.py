"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from recallframe.plans import analysis_queries, memory_queries, retrieval_queries, session_queries

_MODULES = (retrieval_queries, memory_queries, session_queries, analysis_queries)


def queries() -> dict:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}

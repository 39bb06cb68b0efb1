"""Registered queries of the similarity and duplicate-detection operators, and their DuckDB SQL."""

from __future__ import annotations

from lumenfold.plans import image_queries, queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (queries, image_queries):
    for _name, (_query, _sql) in _module.REGISTERED.items():
        QUERIES[_name] = _query
        if _sql:
            ORACLE_SQL[_name] = _sql

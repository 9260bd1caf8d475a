"""All queries of the archive library by name, and their DuckDB counterparts."""

from __future__ import annotations

from . import evaluation_queries, media_queries, ops_queries, output_queries, scoring_queries, window_queries

_FAMILIES = [scoring_queries, window_queries, evaluation_queries, ops_queries, media_queries, output_queries]

QUERIES = {k: f for m in _FAMILIES for k, f in m.QUERIES.items()}
SQL = {k: q for m in _FAMILIES for k, q in m.SQL.items()}

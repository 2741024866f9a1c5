"""The engine's registered queries, with the SQL that says the same."""

from __future__ import annotations

from . import index_queries, panel_queries, stream_queries, work_queries

FLAGSHIP = "agg_monthly_index"
QUERIES: dict = {}
SQL: dict[str, str] = {}
for part in (index_queries, panel_queries, stream_queries, work_queries):
    QUERIES |= part.QUERIES
    SQL |= part.SQL

"""All named queries of the core."""

from __future__ import annotations

from lanthorn.plans import data_queries, detect_queries, merge_queries, native_queries, parse_queries, stream_queries, web_queries

_MODULES = (parse_queries, native_queries, web_queries, merge_queries, detect_queries, stream_queries, data_queries)
QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}

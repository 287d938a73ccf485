"""Every query of the core, with its SQL oracle where SQL can express it."""

from __future__ import annotations

from veritrove.plans import corpus_queries, integrity_queries, packed_queries, source_queries, stream_queries

_MODULES = [packed_queries, integrity_queries, corpus_queries, source_queries, stream_queries]
FLAGSHIP = "stat_audit"
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}

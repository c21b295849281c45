"""All queries of the core and their SQL counterparts."""

from __future__ import annotations

from . import io_queries, nested_queries, relational_queries, vector_queries

_MODULES = (nested_queries, io_queries, relational_queries, vector_queries)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
FLAGSHIP = "stakeholder_positions"

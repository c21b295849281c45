"""All queries of the subpackage and their SQL counterparts."""

from __future__ import annotations

from . import demand_queries, duplicate_queries, knn_queries, language_queries, leakage_queries, mapping_queries, name_queries, packing_queries, personal_data_queries

_MODULES = (demand_queries, duplicate_queries, knn_queries, language_queries, leakage_queries, mapping_queries, name_queries, packing_queries, personal_data_queries)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}

"""All queries of the core library and their SQL."""

from __future__ import annotations

from corpusloom.plans import graph_queries, hierarchy_queries, table_queries

_MODULES = (hierarchy_queries, graph_queries, table_queries)

QUERIES: dict = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.SQL.items()}

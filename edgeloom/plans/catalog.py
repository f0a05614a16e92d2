"""All queries of the core and their SQL."""

from __future__ import annotations

from edgeloom.plans import edge_queries, graph_queries, problems, study_queries

_MODULES = (edge_queries, graph_queries, problems, study_queries)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: f for m in _MODULES for k, f in m.ORACLE.items()}

"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from edgeloom.llm import distinct, frequent, mixing, overlap, packing, toxicity

_MODULES = (overlap, frequent, distinct, packing, mixing, toxicity)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: f for m in _MODULES for k, f in m.ORACLE.items()}

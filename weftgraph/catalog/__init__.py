"""Registered queries: each is an operator applied to the given tables, most with the SQL that must agree."""

from __future__ import annotations


def collect() -> tuple[dict, dict]:
    """(queries, SQL) of all catalogue modules."""
    from . import clusters, events, graph, knowledge, language, levels, stores, tables

    queries, sql = {}, {}
    for module in (graph, events, knowledge, tables, language, levels, clusters, stores):
        queries |= module.REGISTRY.queries
        sql |= module.REGISTRY.sql
    return queries, sql

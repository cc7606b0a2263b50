"""Jobs and registered queries."""

from __future__ import annotations

from plcatlas.plans.registry import Registry


def all_queries() -> Registry:
    from plcatlas.plans import corpus_queries, event_queries, export_queries, graph_queries, plant_queries, store_queries

    merged = Registry()
    for part in (graph_queries, event_queries, corpus_queries, plant_queries, store_queries, export_queries):
        for name, query in part.registry.queries.items():
            merged.define(name, query, part.registry.oracle.get(name))
    return merged

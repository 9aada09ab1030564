from __future__ import annotations


def all_queries():
    """(queries, SQL) of everything but the training-data operators."""
    from tidemark.plans import registry
    from tidemark.plans import queries_basic, queries_domain, queries_joins, queries_research, queries_sources, queries_whole, queries_windows  # noqa: F401

    return registry.QUERIES, registry.ORACLES

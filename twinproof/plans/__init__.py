"""Compositions of operators: evaluation modes, review runs and the registered queries."""


def all_queries():
    """(queries, SQL restatements) of every registered query."""
    from twinproof.plans import queries_core, queries_flow, queries_graph, queries_review  # noqa: F401
    from twinproof.plans.registry import ORACLE, QUERIES

    return QUERIES, ORACLE

"""Jobs composed from operators, and the registry of queries."""


def all_queries() -> dict:
    from tidemark.plans import queries_core, queries_decision, queries_policy, queries_stats
    return {**queries_core.QUERIES, **queries_stats.QUERIES, **queries_policy.QUERIES, **queries_decision.QUERIES}

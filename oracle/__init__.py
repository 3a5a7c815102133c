"""SQL that recomputes every query from the raw tables, for checking."""


def all_sql() -> dict[str, str]:
    from oracle import core, decision, policy, stats
    return {**core.SQL, **stats.SQL, **policy.SQL, **decision.SQL}

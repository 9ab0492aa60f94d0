"""Registered queries over the driver tables, each paired with an oracle SQL."""


def load() -> None:
    """Import every module that registers queries."""
    from workload import catalog_queries, contracts, extraction, more_queries, questions, ranking_queries, relational  # noqa: F401

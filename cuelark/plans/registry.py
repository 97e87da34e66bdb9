"""All queries and oracles of the library."""

from . import interval_queries, more_queries, score_queries, sequence_queries, source_queries

_MODULES = (interval_queries, score_queries, sequence_queries, source_queries, more_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}

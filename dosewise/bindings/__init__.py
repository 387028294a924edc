"""Registered queries: operators bound to the given tables, with their SQL."""

from dosewise.bindings import (  # noqa: F401
    adherence_queries,
    aggregate_queries,
    join_queries,
    model_queries,
    profile_queries,
    row_queries,
    stats_queries,
)
from dosewise.bindings.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

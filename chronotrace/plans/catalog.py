"""Imports every module that registers queries."""

from chronotrace.plans import (  # noqa: F401
    graph_queries,
    interval_queries,
    metric_queries,
    source_queries,
    stateful_queries,
    similarity_queries,
    text_queries,
    window_queries,
)
from chronotrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

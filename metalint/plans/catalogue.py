"""All registered queries."""

from . import check_queries, estate_queries, graph_queries, rollup_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""All queries of the engine by name, and the SQL that must give the same rows."""

from __future__ import annotations

from . import behaviour_queries, feature_queries, file_queries, graph_queries, index_queries, search_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

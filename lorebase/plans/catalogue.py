"""Every query of the engine by name, with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from . import activity_queries, indexing_queries, learning_queries, library_queries, relational_queries, retrieval_queries, stored_queries, text_queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

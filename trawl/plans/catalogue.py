"""Registered queries of the retrieval engine and their SQL oracles."""

from __future__ import annotations

from trawl.plans import file_queries, index_queries, state_queries, text_queries, vector_queries  # noqa: F401  they register themselves
from trawl.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""All registered queries."""

from __future__ import annotations

from hazardflow.plans import file_queries, forest_queries, ingest_queries, model_queries, quality_queries, score_queries, stream_queries  # noqa: F401
from hazardflow.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

"""All registered queries."""

from __future__ import annotations

from eventloom.plans import boost_queries, calib_queries, encode_queries, frames_queries, join_queries, profile_queries, score_queries, sequence_queries, source_queries, traffic_queries  # noqa: F401
from eventloom.plans.registry import QUERIES, SQL

FLAGSHIP = "b1_strictly_before"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]

"""All queries and their oracles, by name."""

from __future__ import annotations

from recordloom.plans import q_duplicates, q_lists, q_metrics, q_state, q_streaming, q_text  # noqa: F401
from recordloom.plans.registry import ORACLES, QUERIES

FLAGSHIP = "kpi_orders"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

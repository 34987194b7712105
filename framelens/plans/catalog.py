"""All registered queries."""

from framelens.plans import audit_queries, gaze_queries, learning_queries, model_queries, source_queries, window_queries  # noqa: F401
from framelens.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

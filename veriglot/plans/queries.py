"""All queries of the engine and their oracle SQL."""

from . import checker_queries, event_queries, fitted_queries, issue_queries, rule_queries, span_queries, surface_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

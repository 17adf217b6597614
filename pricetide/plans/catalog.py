"""Everything that is registered."""

from pricetide.plans import run_queries, source_queries, text_queries, views_queries, watch_queries  # noqa: F401  (importing registers)
from pricetide.plans.registry import builds, oracle_sql, queries

__all__ = ["builds", "oracle_sql", "queries"]

"""Registry of the named contract queries and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module (each registers its queries on import)."""
    from . import (feature_queries, linear_queries, metric_queries, model_queries,  # noqa: F401
                   profile_queries, report_queries, rule_queries, run_queries, series_queries,
                   split_queries, store_queries, text_queries)

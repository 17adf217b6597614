"""Name, Spark query and SQL equivalent, kept side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricetide.plans.views import Bound, with_views

Build = Callable[[Bound], DataFrame]
_BUILDS: dict[str, Build] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query; ``sql`` may name any view in braces."""

    def register(build: Build) -> Build:
        if name in _BUILDS:
            raise KeyError(f"registered twice: {name}")
        _BUILDS[name] = build
        if sql is not None:
            _SQL[name] = sql
        return build

    return register


def _runner(build: Build) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(Bound(spark, folder))

    run.__name__ = build.__name__
    run.__doc__ = build.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(build) for name, build in _BUILDS.items()}


def builds() -> dict[str, Build]:
    """Queries over tables that are bound already, e.g. stored ones."""
    return dict(_BUILDS)


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in _SQL.items()}

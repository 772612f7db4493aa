"""Registered queries over the driver's tables with their SQL cross-checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalmart.adapters import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register a query; ``sql`` may use the named views."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql) if views else sql.strip()
        return fn

    return add


def load() -> None:
    from evalmart.catalog import analytics, integrity, text, curation, release, streams  # noqa: F401

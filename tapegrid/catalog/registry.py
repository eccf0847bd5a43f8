"""Registry of queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from tapegrid.catalog.shape import shape, shape_sql

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(key: str, spec: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key`` with its output spec and SQL."""

    def wrap(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, sf_dir: shape(fn(spark, sf_dir), spec)
        if sql is not None:
            ORACLES[key] = shape_sql(sql, spec)
        return fn

    return wrap

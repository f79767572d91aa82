"""Named queries and, where SQL can state them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def with_ctes(*parts: str) -> str:
    """Join CTE definitions and a final SELECT into one statement."""
    *ctes, body = [p.strip() for p in parts]
    return "WITH " + ",\n".join(ctes) + "\n" + body if ctes else body

"""The registered queries: a Spark callable and, where SQL can say it, the DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def r6(column: str | Column, name: str | None = None) -> Column:
    """A double rounded to 6 digits: sums in another order differ in their last bits."""
    out = F.round(F.col(column) if isinstance(column, str) else column, 6)
    return out.alias(name or column)


def big(column: str | Column, name: str | None = None) -> Column:
    out = (F.col(column) if isinstance(column, str) else column).cast("long")
    return out.alias(name or column)


def joined(column: str | Column, name: str) -> Column:
    """An array of strings as one string, so that every engine prints it alike."""
    return F.array_join(column, "␟").alias(name)

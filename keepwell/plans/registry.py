"""Named queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def rounded(df: DataFrame, digits: int = 6, only: list[str] | None = None) -> DataFrame:
    """Doubles rounded, because sums depend on the order of addition."""
    def cell(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        return F.round(c, digits).alias(name) if kind == "double" and (only is None or name in only) else c

    return df.select(*[cell(n, t) for n, t in df.dtypes])

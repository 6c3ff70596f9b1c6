"""Where queries and their SQL counterparts are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanery.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) under a name, with the SQL that must give the same rows."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def stamp(column: str | Column) -> Column:
    """Text of a nullable timestamp."""
    return F.coalesce(F.date_format(column, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def joined(column: str | Column) -> Column:
    """Text of an array."""
    column = F.col(column) if isinstance(column, str) else column
    return F.array_join(column.cast("array<string>"), ",")


def flag(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("int")

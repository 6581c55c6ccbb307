"""Name -> (Spark query, SQL text) registry behind ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.catalog.views import Views, with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FAMILY: dict[str, str] = {}


def sql_texts() -> dict[str, str]:
    """The SQL of every query that has one, with the views it names spelled out."""
    return {name: with_views(text) for name, text in SQL.items()}


def query(name: str, sql: str | None = None):
    """Register ``fn(Views) -> DataFrame``; ``sql`` may use the named shared views."""

    def wrap(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain_types(fn(Views(spark, sf_dir)))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        FAMILY[name] = fn.__module__.rsplit(".", 1)[-1]
        return fn

    return wrap


def plain_types(df: DataFrame) -> DataFrame:
    """Widen integers to bigint and reals to double, so that both engines return the same types."""

    def widen(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            return c.cast("bigint").alias(field.name)
        if isinstance(field.dataType, (T.FloatType, T.DecimalType)):
            return c.cast("double").alias(field.name)
        return c

    return df.select(*[widen(f) for f in df.schema.fields])


def half_up(expr: str, digits: int = 6) -> str:
    """SQL text for a rounded double without a negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"


def half_even(expr: str, digits: int = 4) -> str:
    # printing rounds the exact binary value
    return f"(CAST(printf('%.{digits}f', CAST({expr} AS DOUBLE)) AS DOUBLE) + 0.0)"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round result columns for comparison between engines."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})

"""Registry and shared expressions of the proxy queries.

Money and event values have two decimals; they are converted to whole cents once, so both engines
compute on integers.  Expressions written as text are portable: both engines read the same string.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _comparable(df: DataFrame) -> DataFrame:
    """Decimals as doubles and timestamps without a zone, as both engines hand them to Python."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double").alias(field.name)
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz").alias(field.name)
        columns.append(column)
    return df.select(*columns)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL text where there is one."""

    def register(function: Query) -> Query:
        QUERIES[name] = lambda spark, sf: _comparable(function(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def derive(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Columns from portable expressions."""
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def sql_columns(columns: Mapping[str, str]) -> str:
    """The same columns as a SQL select list."""
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


def sql_cents(column: str) -> str:
    return f"CAST(round({column} * 100) AS BIGINT)"


def sql_ratio(num: str, den: str, precision: int, scale: int, factor: int = 1) -> str:
    """``factor * num / den`` rounded half up to ``scale`` digits (non-negative operands)."""
    d = f"nullif(CAST({den} AS HUGEINT), 0)"
    units = f"(CAST({num} AS HUGEINT) * {2 * factor * 10**scale} + {d}) // (2 * {d})"
    unit = f"{10**-scale:.{scale}f}" if scale else "1"
    value = f"CAST({units} AS DECIMAL(20, 0)) * CAST({unit} AS DECIMAL({scale + 1}, {scale}))"
    return f"CAST(CAST({value} AS DECIMAL({precision}, {scale})) AS DOUBLE)"

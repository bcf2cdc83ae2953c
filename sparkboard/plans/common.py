"""What the registered queries share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sparkboard.functions.values import quoted


@dataclass(frozen=True)
class Query:
    """One registered query: the operators it covers, how to build it, the SQL to compare with."""

    covers: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def on(name: str, build: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query on one table, with its result in plain types."""
    return lambda spark, folder: plain(build(table(spark, folder, name)))


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and times as text: types which compare alike everywhere."""
    result = []
    for f in df.schema:
        value = quoted(f.name)
        if isinstance(f.dataType, T.DecimalType):
            value = value.cast("double")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            value = value.cast("string")
        result.append(value.alias(f.name))
    return df.select(*result)


def money(column: str) -> str:
    """SQL: a double as an exact amount."""
    return f"CAST({column} AS DECIMAL(18,2))"


def total_sql(column: str) -> str:
    return f"CAST(SUM({money(column)}) AS DOUBLE)"


def average_sql(column: str) -> str:
    # The average of a decimal(18,2) has six places.
    return f"ROUND(CAST(SUM({money(column)}) AS DOUBLE) / COUNT({column}), 6)"


def text_list(column: str) -> Column:
    """`a|b` as an array, the empty text as an empty one."""
    return F.filter(F.split(F.col(column), r"\|"), lambda x: x != "")

"""Question templates: totals, counts, averages, groups, top rows, extremes and time series.

Every function takes the rows of one dataset. Null order is spelled out: groups and rows sorted by
a descending measure begin with the nulls, time series end with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparkboard.functions.values import (
    average_of,
    count_of,
    largest_of,
    measure,
    quoted,
    smallest_of,
    total_of,
)
from sparkboard.sources.csv import with_row_number
from sparkboard.sources.scratch import materialize

FIRST_ROWS_DEFAULT, FIRST_ROWS_MAX = 10, 100
TOP_ROWS_DEFAULT = 5
# Rows one task may merge from all others; the result does not depend on it.
TOP_ROWS_IN_ONE_TASK = 10_000
AGGREGATES = {
    "sum": total_of, "avg": average_of, "count": count_of, "min": smallest_of, "max": largest_of
}
GRAINS = ("day", "week", "month", "quarter", "year")


def first_rows(df: DataFrame, order_by: str | Sequence[str], n: int = FIRST_ROWS_DEFAULT) -> DataFrame:
    """The first rows in the order of a row number or key; between 1 and 100 of them."""
    keys = [order_by] if isinstance(order_by, str) else order_by
    return df.orderBy(*[quoted(k).asc() for k in keys]).limit(max(1, min(n, FIRST_ROWS_MAX)))


def as_date(df: DataFrame, name: str) -> Column:
    return quoted(name).cast("date")


def extreme_date(
    df: DataFrame, date: str, metric: str, highest: bool = True, scale: int | None = None
) -> DataFrame:
    """The date whose total of the metric is highest or lowest; the earliest one of equal totals."""
    totals = df.groupBy(as_date(df, date).alias(date)).agg(
        total_of(df, metric, scale).alias(f"total_{metric}")
    )
    return _first_by(totals, f"total_{metric}", date, highest)


def extreme_group(
    df: DataFrame,
    dimension: str,
    metric: str,
    aggregate: str = "sum",
    highest: bool = True,
    scale: int | None = None,
) -> DataFrame:
    """The value of any dimension with the highest or lowest aggregate, together with it."""
    name = f"{aggregate}_{metric}"
    groups = df.groupBy(quoted(dimension).alias(dimension)).agg(
        AGGREGATES[aggregate](df, metric, scale).alias(name)
    )
    return _first_by(groups, name, dimension, highest)


def _first_by(groups: DataFrame, value: str, key: str, highest: bool) -> DataFrame:
    total = quoted(value)
    first = total.desc_nulls_last() if highest else total.asc_nulls_last()
    return groups.orderBy(first, quoted(key).asc_nulls_last()).limit(1)


def total(df: DataFrame, metric: str, scale: int | None = None) -> DataFrame:
    return df.agg(total_of(df, metric, scale).alias(f"total_{metric}"))


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """Distinct non-null values; the exact count shuffles each value once per map task."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count(quoted(column)).alias(f"count_{column}"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_count"))


def average(df: DataFrame, metric: str, scale: int | None = None) -> DataFrame:
    return df.agg(average_of(df, metric, scale).alias(f"avg_{metric}"))


def grouped(
    df: DataFrame, group: str, metric: str, aggregate: str = "sum", scale: int | None = None
) -> DataFrame:
    """The aggregate per group under the name of the metric, largest first."""
    return _groups(df, group, metric, aggregate, metric, scale)


def groups_with_total(df: DataFrame, group: str, metric: str, scale: int | None = None) -> DataFrame:
    """Every group with its total, largest first."""
    return _groups(df, group, metric, "sum", f"total_{metric}", scale)


def _groups(
    df: DataFrame, group: str, metric: str, aggregate: str, name: str, scale: int | None
) -> DataFrame:
    value = AGGREGATES[aggregate](df, metric, scale).alias(name)
    return df.groupBy(quoted(group).alias(group)).agg(value).orderBy(
        quoted(name).desc_nulls_first(), quoted(group).asc_nulls_first()
    )


def top_rows(
    df: DataFrame,
    column: str,
    metric: str,
    n: int = TOP_ROWS_DEFAULT,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """The rows (not groups) with the largest metric. One column when both names are the same.

    Up to `TOP_ROWS_IN_ONE_TASK` rows are merged by one task. More are sorted over all tasks, written
    and numbered, so that no task holds them all.
    """
    value = measure(df, metric)
    shown = [value.alias(metric)] if column == metric else [quoted(column), value.alias(metric)]
    keys = [quoted(k) for k in (tie_break or [column])]
    hidden = [f"__key{i}" for i in range(len(keys))]
    ranked = df.select(*shown, *[k.alias(h) for k, h in zip(keys, hidden, strict=True)]).orderBy(
        quoted(metric).desc_nulls_first(), *[F.asc(h) for h in hidden]
    )
    if n <= TOP_ROWS_IN_ONE_TASK:
        return ranked.limit(n).drop(*hidden)
    written = materialize(ranked.drop(*hidden), "sorted-rows")
    place = "__number"
    return with_row_number(written, place).filter(F.col(place) <= n).orderBy(place).drop(place)


def time_series(
    df: DataFrame, date: str, metric: str, grain: str | None = None, scale: int | None = None
) -> DataFrame:
    """The total per value of the date column, in time order; `grain` groups by day, month, ..."""
    if grain is not None and grain not in GRAINS:
        raise ValueError(f"grain is one of {GRAINS}, not {grain!r}")
    moment = quoted(date) if grain is None else F.date_trunc(grain, quoted(date)).cast("date")
    return (
        df.groupBy(moment.alias(date))
        .agg(total_of(df, metric, scale).alias(f"total_{metric}"))
        .orderBy(quoted(date).asc_nulls_last())
    )


def sql_view(df: DataFrame, statement: str, name: str = "dataset") -> DataFrame:
    """Run a query over the dataset, which the statement knows under `name`; nothing but a query.

    The name is known while the statement is read, and no longer; a name in use is refused.
    """
    spark = df.sparkSession
    spark._jsparkSession.sessionState().sqlParser().parseQuery(statement)  # fails for commands
    df.createTempView(name)
    try:
        return spark.sql(statement)
    finally:
        spark.catalog.dropTempView(name)

"""From a query result to points of a chart, and from result sizes to a kind of answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from sparkboard.functions.values import parse_number, quoted
from sparkboard.sources.scratch import materialize

UNKNOWN_LABEL = "Unknown"
# Fixed value: a dashboard with fewer working charts than this carries a warning.
MIN_CHARTS = 6

TIMESTAMPS = (T.TimestampType, T.TimestampNTZType)


def label(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(UNKNOWN_LABEL))


def point_value(value: Column, kind: T.DataType) -> Column:
    """A number for the axis: nulls, dates and texts which are no number count as 0."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        number = value.cast("double")
    elif isinstance(kind, T.StringType):
        number = parse_number(value)
    else:
        number = F.lit(None).cast("double")
    return F.coalesce(number, F.lit(0.0))


def points(result: DataFrame) -> DataFrame:
    """Long form of a query result: (label, series, value).

    The first column is the label, every other one a series. A timestamp stays text, in the extra
    column `value_text` which appears only if there is one. One column alone gives its first row.
    """
    fields = result.schema.fields
    if len(fields) == 1:
        return single_value(result)
    first, rest = fields[0], fields[1:]
    has_text = any(isinstance(f.dataType, TIMESTAMPS) for f in rest)
    series = []
    for f in rest:
        moment = isinstance(f.dataType, TIMESTAMPS)
        number = F.lit(None).cast("double") if moment else point_value(quoted(f.name), f.dataType)
        parts = [F.lit(f.name).alias("series"), number.alias("value")]
        if has_text:
            text = quoted(f.name).cast("string") if moment else F.lit(None).cast("string")
            parts.append(text.alias("value_text"))
        series.append(F.struct(*parts))
    return result.select(
        label(quoted(first.name)).alias("label"), F.explode(F.array(*series)).alias("point")
    ).select("label", "point.*")


def single_value(result: DataFrame) -> DataFrame:
    """The first row of a one-column result, as a number where it is one; null counts as 0."""
    field = result.schema.fields[0]
    value = quoted(field.name)
    if isinstance(field.dataType, (T.NumericType, T.BooleanType)):
        value = F.coalesce(value, F.lit(0).cast(field.dataType))
    else:
        value = F.coalesce(value.cast("string"), F.lit("0"))
    return result.limit(1).select(value.alias("value"))


def shape_of(n_rows: Column, n_columns: Column) -> Column:
    """Kind of answer by the size of the result."""
    return (
        F.when(n_rows == 0, "empty")
        .when((n_rows == 1) & (n_columns == 1), "kpi")
        .when((n_rows > 1) & (n_columns == 2), "chart")
        .otherwise("table")
    )


def result_shape(result: DataFrame) -> str:
    """Kind of answer for one result; two of its rows are enough to tell."""
    return shape_by(result.limit(2).count(), len(result.columns))


def shape_by(rows: int, columns: int) -> str:
    """Kind of answer by the size of one result."""
    if rows == 0:
        return "empty"
    if columns == 1:
        return "kpi" if rows == 1 else "table"
    return "chart" if columns == 2 and rows > 1 else "table"


def counted(result: DataFrame) -> tuple[DataFrame, int]:
    """The result, written in the one run of its plan, and how many rows passed by. Its order is kept."""
    seen, place = Observation(), "__place"
    rows = result.observe(seen, F.count(F.lit(1)).alias("n")).withColumn(place, F.monotonically_increasing_id())
    written = materialize(rows, "answer")
    return written.orderBy(place).drop(place), seen.get["n"]


def dashboard_summary(charts: DataFrame, by: str | None = None) -> DataFrame:
    """Charts by outcome, from a table with `status`; `too_few` below six working ones."""
    groups = charts.groupBy(by) if by else charts.groupBy()
    return groups.agg(
        F.count(F.lit(1)).alias("total_charts"),
        F.count_if(F.col("status") == "success").alias("successful_charts"),
        F.count_if(F.col("status") == "skipped").alias("skipped_charts"),
        F.count_if(F.col("status") == "failed").alias("failed_charts"),
    ).withColumn("too_few", F.col("successful_charts") < MIN_CHARTS)


def point_counts(long: DataFrame) -> DataFrame:
    """Data points per chart, from the long form of many charts."""
    return long.groupBy("chart_id").agg(F.count(F.lit(1)).alias("row_count"))

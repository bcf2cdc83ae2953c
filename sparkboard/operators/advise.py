"""Which chart type fits a chart specification: rules over a table of specifications.

A specification row carries its own schema as an array of (name, type), so the rules are a
projection over the row. The result is the corrected type and, for a chart which cannot be drawn,
the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkboard.functions.values import quoted
from sparkboard.operators.charts import metric_column

# Fixed value: a metric beginning with one of these is an aggregate, whatever its column holds.
IS_AGGREGATE = r"^(COUNT|SUM|AVG|MIN|MAX|MEDIAN|STDDEV|VARIANCE)(\(|\z)"
UNKNOWN = "unknown"

# Why a chart is skipped.
NOT_NUMERIC = "Non-aggregated metrics must be numeric (non-numeric: [{}])"
NO_AXIS = "{} chart requires at least a time or numeric x-axis"
TOO_FEW_CATEGORIES = "Heatmap requires 2 categorical dimensions (found {})"
NO_BAR_DIMENSION = "Bar chart requires at least 1 dimension"
NO_PIE_DIMENSION = "Pie chart requires at least 1 dimension"


def _fill(text: str, part: Column) -> Column:
    before, after = text.split("{}")
    return F.concat(F.lit(before), part.cast("string"), F.lit(after))


def column_types(names: Column, columns: Column) -> Column:
    """The logical types of the distinct names, in their order; `unknown` for a foreign name."""
    # Of a repeated name the last one counts.
    def type_of(name: Column) -> Column:
        return F.try_element_at(F.filter(columns, lambda c: c["name"] == name), F.lit(-1))["type"]

    return F.transform(
        F.array_distinct(names),
        lambda n: F.struct(n.alias("name"), F.coalesce(type_of(n), F.lit(UNKNOWN)).alias("type")),
    )


def _count(types: Column, *kinds: str) -> Column:
    return F.size(F.filter(types, lambda t: t["type"].isin(*kinds)))


def wrong_metrics(metrics: Column, columns: Column) -> Column:
    """Columns of metrics which are neither aggregated nor numbers (unknown columns pass)."""
    bare = F.filter(metrics, lambda m: ~F.upper(F.btrim(m)).rlike(IS_AGGREGATE))
    types = column_types(F.transform(bare, metric_column), columns)
    return F.transform(
        F.filter(types, lambda t: ~t["type"].isin("numeric", UNKNOWN)), lambda t: t["name"]
    )


def advise(
    specs: DataFrame,
    columns: str = "columns",
    chart_type: str = "chart_type",
    dimensions: str = "dimensions",
    metrics: str = "metrics",
) -> DataFrame:
    """Add `corrected_type` and `skip_reason` to chart specifications.

    Rules apply in order and a corrected type is final.
    """
    prepared = specs.withColumns({
        "__type": F.lower(quoted(chart_type)),
        "__types": column_types(quoted(dimensions), quoted(columns)),
        "__wrong": wrong_metrics(quoted(metrics), quoted(columns)),
    }).withColumns({
        "__categories": _count(F.col("__types"), "categorical", "text"),
        "__numbers": _count(F.col("__types"), "numeric"),
        "__dates": _count(F.col("__types"), "datetime"),
    })
    kind, categories = F.col("__type"), F.col("__categories")
    numbers, dates = F.col("__numbers"), F.col("__dates")
    over_time = kind.isin("line", "area") & (dates == 0)
    no_reason = F.lit(None).cast("string")

    def become(new_type: str) -> Column:
        return F.struct(F.lit(new_type).alias("corrected_type"), no_reason.alias("skip_reason"))

    def skip(reason: Column) -> Column:
        return F.struct(kind.alias("corrected_type"), reason.alias("skip_reason"))

    quoted_names = F.concat(F.lit("'"), F.array_join("__wrong", "', '"), F.lit("'"))
    advice = (
        F.when(F.size("__wrong") > 0, skip(_fill(NOT_NUMERIC, quoted_names)))
        .when((kind == "bar") & (categories >= 2), become("heatmap"))
        .when((kind == "scatter") & ((categories > 0) | (numbers < 2)), become("bar"))
        .when((kind == "area") & (categories == 2), become("heatmap"))
        .when(over_time & (categories > 0), become("bar"))
        .when(over_time & (numbers == 0), skip(_fill(NO_AXIS, F.initcap(kind))))
        .when(
            (kind == "heatmap") & (categories == 1) & (F.size(quoted(metrics)) > 0), become("bar")
        )
        .when((kind == "heatmap") & (categories < 2), skip(_fill(TOO_FEW_CATEGORIES, categories)))
        .when((kind == "bar") & (F.size(quoted(dimensions)) == 0), skip(F.lit(NO_BAR_DIMENSION)))
        .when((kind == "pie") & (F.size(quoted(dimensions)) == 0), skip(F.lit(NO_PIE_DIMENSION)))
        .otherwise(skip(no_reason))
    )
    return prepared.withColumn("__advice", advice).select(*specs.columns, "__advice.*")

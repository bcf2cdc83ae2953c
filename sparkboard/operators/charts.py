"""Chart data: grouped aggregates, shares, distributions, cross-tables, correlations and KPIs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkboard.functions.values import (
    average_of,
    largest_of,
    measure,
    quoted,
    smallest_of,
    total_of,
)
from sparkboard.operators.ask import GRAINS
from sparkboard.operators.gram import wide_correlations
from sparkboard.operators.quantiles import attach, group_columns, group_values, quantiles
from sparkboard.operators.shape import label, point_value
from sparkboard.sources.scratch import materialize

# The aggregates a metric text can name; COUNT needs no column and MEDIAN is a quantile.
METRICS = {
    "COUNT": None,
    "SUM": total_of,
    "AVG": average_of,
    "MIN": smallest_of,
    "MAX": largest_of,
    "MEDIAN": None,
    "STDDEV": lambda df, name, scale: F.stddev_samp(measure(df, name, scale)),
    "VARIANCE": lambda df, name, scale: F.var_samp(measure(df, name, scale)),
}
TABLE_ROWS = 50
# Columns whose pairs (36) are aggregates of one plan; plans grow with the square of the columns.
CORRELATED_AT_ONCE = 8


@dataclass(frozen=True)
class Chart:
    """One chart specification."""

    chart_id: str
    chart_type: str
    dimensions: tuple[str, ...]
    metrics: tuple[str, ...] = ()
    title: str = ""
    description: str = ""
    priority: int = 1


def metric_column(metric: Column) -> Column:
    """The text inside the brackets, else the metric itself: `AVG(revenue)` -> `revenue`."""
    inner = F.regexp_extract(metric, r"\(([^)]+)\)", 1)
    return F.when(inner != "", inner).otherwise(metric)


def parse_metric(metric: str) -> tuple[str, str | None]:
    """`AVG(revenue)` -> ("AVG", "revenue"); a bare column is summed; COUNT needs no column."""
    head, bracket, rest = metric.strip().partition("(")
    name, inner = head.strip().upper(), rest.rstrip(") ").strip()
    if bracket:
        if name not in METRICS:
            raise ValueError(f"unknown aggregate in {metric!r}")
        return name, None if inner in ("", "*") else inner
    return ("COUNT", None) if name == "COUNT" else ("SUM", head.strip())


def metric_alias(metric: str) -> str:
    name, column = parse_metric(metric)
    return f"{name.lower()}_{column}" if column else name.lower()


def aggregate(df: DataFrame, metric: str, scale: int | None = None) -> Column:
    """The aggregate a metric text stands for."""
    name, column = parse_metric(metric)
    if name == "MEDIAN":
        raise ValueError("MEDIAN is computed by medians() or chart()")
    if name == "COUNT":
        value = F.count(F.lit(1) if column is None else quoted(column))
    else:
        value = METRICS[name](df, column, scale)
    return value.alias(metric_alias(metric))


def medians(df: DataFrame, dimensions: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """The exact medians per group: {name of the result: column}. All columns are narrowed down together."""
    groups = [quoted(d).alias(f"__g{i}") for i, d in enumerate(dimensions)]
    each = [F.struct(F.lit(i).alias("which"), measure(df, c).cast("double").alias("value")) for i, c in enumerate(columns.values())]
    long = df.select(*groups, F.explode(F.array(*each)).alias("__m")).select("*", "__m.which", F.col("__m.value").alias("__value"))
    keys = [*(f"__g{i}" for i in range(len(dimensions))), "which"]
    values = group_values(long, F.col("__value"), [F.col(k) for k in keys])
    found = quantiles(values, (0.5,))
    *own, which = group_columns(values)
    per_group = found.groupBy(*own).agg(
        *[F.max(F.when(F.col(which) == i, F.col("q0"))).alias(f"__q{i}") for i in range(len(columns))]
    )
    names = [F.col(g).alias(d) for g, d in zip(own, dimensions, strict=True)]
    return per_group.select(*names, *[F.col(f"__q{i}").alias(n) for i, n in enumerate(columns)])


def chart(
    df: DataFrame, dimensions: Sequence[str], metrics: Sequence[str], scale: int | None = None
) -> DataFrame:
    """All metrics over the dimensions in one aggregation; medians are joined to it."""
    metrics = list(metrics) or ["COUNT"]
    plain = [m for m in metrics if parse_metric(m)[0] != "MEDIAN"]
    groups = [quoted(d).alias(d) for d in dimensions]
    result = df.groupBy(*groups).agg(*[aggregate(df, m, scale) for m in plain or ["COUNT"]])
    if wanted := {metric_alias(m): parse_metric(m)[1] for m in metrics if m not in plain}:
        found = medians(df, dimensions, wanted)
        if dimensions:
            result = attach(result, found, dimensions, "left")
        else:
            only = found.select(F.struct(*[quoted(n) for n in wanted])).scalar()
            result = result.withColumn("__medians", only)
            result = result.select("*", *[F.col("__medians")[n].alias(n) for n in wanted]).drop("__medians")
    return result.select(*[quoted(c) for c in (*dimensions, *map(metric_alias, metrics))])


SET = "__set"


@dataclass(frozen=True)
class Grouped:
    """Groups of several dimension lists from one aggregation; `of` gives those of one list, as `chart` would."""

    rows: DataFrame
    own: Mapping[str, str]
    metrics: tuple[str, ...]

    def of(self, dimensions: Sequence[str], metrics: Sequence[str]) -> DataFrame:
        chosen = self.rows.where(F.col(SET) == _set_number(list(self.own), dimensions))
        return chosen.select(*[F.col(self.own[d]).alias(d) for d in dimensions], *[quoted(metric_alias(m)) for m in metrics])


def _set_number(every: Sequence[str], chosen: Sequence[str]) -> int:
    """The grouping id of a dimension list: a bit for each dimension that is not in it, the first one's highest."""
    return sum(1 << (len(every) - 1 - i) for i, d in enumerate(every) if d not in chosen)


def grouped(df: DataFrame, requests: Sequence[tuple[Sequence[str], Sequence[str]]], scale: int | None = None) -> Grouped:
    """The charts (dimensions, metrics) in one scan and one shuffle, as grouping sets. No medians.

    Every list of dimensions gets all metrics, which are partial sums before anything moves. A table without
    rows has no row for an empty list.
    """
    dimensions = list(dict.fromkeys(d for asked, _ in requests for d in asked))
    metrics = tuple({metric_alias(m): m for _, asked in requests for m in asked}.values())
    if len(dimensions) > 63:
        raise ValueError("more than 63 dimensions in one aggregation")
    own = {d: f"__d{i}" for i, d in enumerate(dimensions)}
    values = [aggregate(df, m, scale) for m in metrics]
    if not own:
        return Grouped(df.groupBy().agg(F.lit(0).cast("long").alias(SET), *values), own, metrics)
    sets = [list(x) for x in dict.fromkeys(tuple(own[d] for d in own if d in asked) for asked, _ in requests)]
    wide = df.withColumns({name: quoted(d) for d, name in own.items()})
    return Grouped(wide.groupingSets(sets, *own.values()).agg(F.grouping_id().alias(SET), *values), own, metrics)


def bar(df: DataFrame, x: str, metric: str | None = None, scale: int | None = None) -> DataFrame:
    """One bar per value; without a metric the dimension itself is the measure."""
    return chart(df, [x], [metric or f"SUM({x})"], scale).orderBy(quoted(x).asc_nulls_last())


def stacked_bar(
    df: DataFrame, x: str, series: str, metric: str, scale: int | None = None
) -> DataFrame:
    """Bars split by a second dimension, in long form (also for grouped bars)."""
    return chart(df, [x, series], [metric], scale)


def line(
    df: DataFrame, x: str, metrics: Sequence[str], grain: str | None = None, scale: int | None = None
) -> DataFrame:
    """Points in the order of a time or number axis; an area chart has the same data.

    `grain` groups by hour (points are times) or by day, week, month, quarter, year (points are dates).
    """
    axis = quoted(x) if grain is None else period_of(quoted(x), grain)
    # The axis is one of the metrics' columns at times: it gets a name of its own.
    own = _free("axis", df.columns)
    points = chart(df.withColumn(own, axis), [own], metrics, scale)
    return points.withColumnRenamed(own, x).orderBy(quoted(x).asc_nulls_last())


def period_of(moment: Column, grain: str) -> Column:
    if grain not in (*GRAINS, "hour"):
        raise ValueError(f"grain is hour or one of {GRAINS}, not {grain!r}")
    start = F.date_trunc(grain, moment)
    return start if grain == "hour" else start.cast("date")


def _free(name: str, taken: Sequence[str]) -> str:
    """A column name nobody uses."""
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def pie(
    df: DataFrame, name: str, metric: str | None = None, scale: int | None = None
) -> DataFrame:
    """Slices and their share of the whole; a slice of 0 or null falls back to its row count."""
    own, rows = _free("slice", df.columns), _free("rows", df.columns)
    counts = df.groupBy(quoted(name).alias(own)).agg(F.count(F.lit(1)).alias(rows))
    value = F.lit(None).cast("double")
    if metric is not None:
        value = F.nullif(quoted(metric_alias(metric)).cast("double"), F.lit(0.0))
        if parse_metric(metric)[0] == "MEDIAN":
            groups = chart(df.withColumn(own, quoted(name)), [own], [metric], scale)
            counts = attach(counts, groups, [own], "left")
        else:
            counts = df.groupBy(quoted(name).alias(own)).agg(F.count(F.lit(1)).alias(rows), aggregate(df, metric, scale))
    slices = counts.select(
        label(quoted(own)).alias("label"),
        F.coalesce(value, F.nullif(quoted(rows), F.lit(0)).cast("double"), F.lit(1.0)).alias("value"),
    )
    # The total comes from the slices, one row each, not from a second look at the data.
    whole = slices.agg(F.sum("value")).scalar()
    return slices.withColumn("share", F.col("value") / whole)


def scatter(
    df: DataFrame, x: str, y: str, fraction: float | None = None, key: Sequence[str] = ()
) -> DataFrame:
    """Pairs of two numeric columns; `fraction` keeps a part chosen by the hash of the key."""
    rows = df
    if fraction is not None:
        place = F.pmod(F.xxhash64(*[quoted(k) for k in (key or df.columns)]), F.lit(1_000_000))
        rows = df.filter(place < round(fraction * 1_000_000))
    return rows.select(quoted(x), quoted(y)).dropna()


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins from the smallest to the largest value; empty bins are shown with 0.

    NaN and infinities have no place on the axis and are left out.
    """
    values = df.select(measure(df, column).cast("double").alias("v")).filter(
        F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
    )
    limits = values.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("s")).scalar()
    placed = values.withColumn("s", limits).select("v", "s.lo", "s.hi")
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(
        width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))
    ).otherwise(F.lit(0))
    counted = placed.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    step = (F.col("s.hi") - F.col("s.lo")) / bins
    return (
        every.join(counted, "bin", "left")
        .withColumn("s", limits)
        .filter("s.lo is not null")
        .select(
            "bin",
            (F.col("s.lo") + F.col("bin") * step).alias("low"),
            (F.col("s.lo") + (F.col("bin") + 1) * step).alias("high"),
            F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
        )
    )


def box(
    df: DataFrame, column: str, by: Sequence[str] = (), method: str = "linear"
) -> DataFrame:
    """Quartiles, whiskers (extreme values within 1.5 interquartile ranges) and outliers."""
    values = group_values(df, measure(df, column), [quoted(b) for b in by])
    groups = group_columns(values)
    quartiles = materialize(quantiles(values, (0.25, 0.5, 0.75), method), "quartiles")
    reach = 1.5 * (F.col("q2") - F.col("q0"))
    fenced = attach(
        values,
        quartiles.select(
            *groups, (F.col("q0") - reach).alias("low_fence"), (F.col("q2") + reach).alias("high_fence")
        ),
        groups,
    )
    inside = F.col("value").between(F.col("low_fence"), F.col("high_fence"))
    ends = fenced.groupBy(*groups).agg(
        F.min(F.when(inside, F.col("value"))).alias("low_whisker"),
        F.max(F.when(inside, F.col("value"))).alias("high_whisker"),
        F.count_if(~inside).alias("outliers"),
    )
    boxes = attach(ends, quartiles, groups).filter(F.col("rows").isNotNull())
    return boxes.select(
        *[F.col(g).alias(b) for g, b in zip(groups, by, strict=True)],
        F.col("rows").alias("n"),
        F.col("lo").alias("min"),
        "low_whisker",
        F.col("q0").alias("q1"),
        F.col("q1").alias("median"),
        F.col("q2").alias("q3"),
        "high_whisker",
        F.col("hi").alias("max"),
        "outliers",
    )


def heatmap(
    df: DataFrame, x: str, y: str, metric: str = "COUNT", scale: int | None = None
) -> DataFrame:
    """Cross-table of two dimensions in long form: one row per filled cell."""
    return chart(df, [x, y], [metric], scale)


def heatmap_wide(
    df: DataFrame,
    x: str,
    y: str,
    metric: str = "COUNT",
    values: Sequence | None = None,
    scale: int | None = None,
) -> DataFrame:
    """Cross-table with one column per value of `x`; unnamed values are read from the cells first."""
    cells = heatmap(df, x, y, metric, scale)
    if values is None:
        cells = materialize(cells, "heatmap-cells")
    cell = F.first(metric_alias(metric))
    return cells.groupBy(y).pivot(x, list(values) if values is not None else None).agg(cell)


def _correlation(x: Column, y: Column) -> Column:
    # corr() fails for constant columns.
    spreads = [F.stddev_samp(F.when(other.isNotNull(), own)) for own, other in ((x, y), (y, x))]
    return F.try_divide(F.covar_samp(x, y), spreads[0] * spreads[1])


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in one pass: a row of aggregates, or blocks of many columns.

    A pair is looked at in the rows in which both have a value; it is null for fewer than two of them and where a
    column is constant in them.
    """
    numbers = df.select(*[measure(df, c).cast("double").alias(c) for c in columns])
    if len(columns) > CORRELATED_AT_ONCE:
        return wide_correlations(numbers)
    pairs = list(combinations_with_replacement(columns, 2))
    row = numbers.agg(*[
        _correlation(quoted(a), quoted(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)
    ])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for left, right in dict.fromkeys([(a, b), (b, a)]):
            cells.append(F.struct(
                F.lit(left).alias("x"), F.lit(right).alias("y"), F.col(f"c{i}").alias("correlation")
            ))
    return row.select(F.inline(F.array(*cells)))


def kpi_card(df: DataFrame, column: str, scale: int | None = None) -> DataFrame:
    return df.agg(
        total_of(df, column, scale).alias("primary_value"),
        average_of(df, column, scale).alias("average"),
        largest_of(df, column, scale).alias("max"),
        smallest_of(df, column, scale).alias("min"),
    )


def kpi_change(
    df: DataFrame,
    date: str,
    metric: str,
    grain: str = "month",
    by: Sequence[str] = (),
    scale: int | None = None,
) -> DataFrame:
    """The metric per period, with the period before it and the direction of the change.

    Only one row per period (and group) is left when the window looks back.
    """
    if clash := {"period", "value", "previous_value", "change", "change_type"} & set(by):
        raise ValueError(f"the result has columns of its own named {sorted(clash)}; rename those of the groups")
    own, value = _free("period", df.columns), metric_alias(metric)
    periods = chart(df.withColumn(own, period_of(quoted(date), grain)), [*by, own], [metric], scale)
    periods = periods.select(*[quoted(b) for b in by], quoted(own).alias("period"), quoted(value).alias("value"))
    before = Window.partitionBy(*[quoted(b) for b in by]).orderBy("period")
    change = F.col("value") - F.col("previous_value")
    return (
        periods.withColumn("previous_value", F.lag("value").over(before))
        .withColumn("change", change)
        .withColumn(
            "change_type",
            F.when(F.col("change") > 0, "positive").when(F.col("change") < 0, "negative")
            .otherwise("neutral"),
        )
    )


def table_panel(df: DataFrame, order_by: Sequence[str], rows: int = TABLE_ROWS) -> DataFrame:
    """The first rows of a table, each with the number of rows in all."""
    shown = df.orderBy(*[quoted(k) for k in order_by]).limit(rows)
    return shown.withColumn("total_rows", df.agg(F.count(F.lit(1))).scalar())


def dashboard(
    df: DataFrame, charts: Sequence[Chart], scale: int | None = None
) -> DataFrame:
    """Many grouped charts in one result: long form (chart_id, label, series, value).

    Charts with the same dimensions share one aggregation, which reads the columns they name and no
    others. With two dimensions the second one names the series.
    """
    known = set(df.columns)
    shared: dict[tuple[str, ...], list[Chart]] = {}
    for c in charts:
        needed = {*c.dimensions, *[col for m in c.metrics if (col := parse_metric(m)[1])]}
        if missing := sorted(needed - known):
            raise ValueError(f"chart {c.chart_id}: no column {', '.join(missing)}")
        if not 1 <= len(c.dimensions) <= 2:
            raise ValueError(f"chart {c.chart_id}: one or two dimensions, not {len(c.dimensions)}")
        shared.setdefault(tuple(dict.fromkeys(c.dimensions)), []).append(c)
    parts = []
    for dimensions, own in shared.items():
        metrics = dict.fromkeys(m for c in own for m in (c.metrics or ("COUNT",)))
        result = chart(df, dimensions, list(metrics), scale)
        cells = [_cell(result, c, m) for c in own for m in (c.metrics or ("COUNT",))]
        parts.append(result.select(F.explode(F.array(*cells)).alias("p")).select("p.*"))
    return reduce(DataFrame.unionByName, parts)


def _cell(result: DataFrame, c: Chart, metric: str) -> Column:
    """One point of a chart from a row of grouped results."""
    name = metric_alias(metric)
    series = label(quoted(c.dimensions[1])) if len(c.dimensions) > 1 else F.lit(name)
    return F.struct(
        F.lit(c.chart_id).alias("chart_id"),
        label(quoted(c.dimensions[0])).alias("label"),
        series.alias("series"),
        point_value(quoted(name), result.schema[name].dataType).alias("value"),
    )

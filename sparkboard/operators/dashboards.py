"""A dashboard from chart specifications: rules first, then every chart's points, then its status.

A chart which the rules find unfit is skipped, one which cannot be computed has failed; the others are
drawn whatever became of these.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F, types as T

from sparkboard.functions.values import quoted
from sparkboard.operators import charts
from sparkboard.operators.advise import advise
from sparkboard.operators.charts import Chart, parse_metric
from sparkboard.operators.route import schema_array
from sparkboard.operators.shape import label, point_value, points
from sparkboard.sources.scratch import local_table, materialize

POINTS = "chart_id string, label string, series string, value double"
STATUS = T.StructType([
    T.StructField("chart_id", T.StringType(), False),
    T.StructField("chart_type", T.StringType()),
    T.StructField("corrected_type", T.StringType()),
    T.StructField("status", T.StringType(), False),
    T.StructField("reason", T.StringType()),
    T.StructField("row_count", T.LongType()),
])
SPECS = T.StructType([
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("chart_type", T.StringType()),
    T.StructField("dimensions", T.ArrayType(T.StringType())),
    T.StructField("metrics", T.ArrayType(T.StringType())),
])
#: Chart types which are one aggregation over one or two dimensions.
PLAIN = ("bar", "line", "area", "heatmap", "stacked_bar")
#: What makes a chart fail, and how many are computed side by side.
FAILURES = (PySparkException, ValueError, TypeError, KeyError)
AT_ONCE = 4
BOX_SERIES = ("min", "low_whisker", "q1", "median", "q3", "high_whisker", "max", "outliers")


@dataclass(frozen=True)
class Dashboard:
    """status: a row per chart; points: those of all charts which succeeded."""

    status: DataFrame
    points: DataFrame


def dashboard(
    df: DataFrame, columns: DataFrame, specs: Sequence[Chart], scale: int | None = None, order_by: Sequence[str] = (),
    fraction: float | None = None,
) -> Dashboard:
    """Run the charts over the rows; `columns` is their profile, `order_by` what the first rows of a table are.

    Grouped charts share one scan and one shuffle; the others are computed side by side. Points are written:
    a chart which fails while it is computed leaves the others alone, and none is computed twice. `fraction`
    keeps a part of a scatter chart's rows, chosen by their hash.
    """
    spark = df.sparkSession
    rows = [(i, c.chart_type, list(c.dimensions), list(c.metrics)) for i, c in enumerate(specs)]
    table = local_table(spark, rows, SPECS).withColumn("columns", schema_array(columns))
    advice = {r["ordinal"]: r for r in advise(table).select("ordinal", "corrected_type", "skip_reason").collect()}
    kinds = {i: advice[i]["corrected_type"] for i in range(len(specs))}
    todo = [i for i in kinds if advice[i]["skip_reason"] is None]
    shared, counts = _grouped(df, {i: (specs[i], kinds[i]) for i in todo}, scale)
    drawn: list[DataFrame] = [shared] if shared is not None else []

    def alone(i: int) -> tuple[DataFrame | None, int | None, str | None]:
        try:
            found = draw(df, columns, specs[i], kinds[i], scale, order_by, fraction)
            found = materialize(found.select(F.lit(specs[i].chart_id).alias("chart_id"), "label", "series", "value"), "chart")
            return found, found.count(), None
        except FAILURES as error:
            return None, None, str(error).strip().splitlines()[0] if str(error).strip() else type(error).__name__

    others = [i for i in todo if i not in counts]
    with ThreadPoolExecutor(AT_ONCE) as threads:
        outcomes = dict(zip(others, threads.map(alone, others)))
    drawn += [found for found, _, _ in outcomes.values() if found is not None]
    status = []
    for i, c in enumerate(specs):
        if i not in todo:
            row = "skipped", advice[i]["skip_reason"], None
        elif i in counts:
            row = "success", None, counts[i]
        else:
            found, n, reason = outcomes[i]
            row = ("failed", reason, None) if found is None else ("success", None, n)
        status.append((c.chart_id, c.chart_type, kinds[i], *row))
    all_points = reduce(DataFrame.unionByName, drawn) if drawn else spark.createDataFrame([], POINTS)
    return Dashboard(local_table(spark, status, STATUS), all_points)


def _request(df: DataFrame, c: Chart, kind: str) -> tuple[list[str], list[str]] | None:
    """The groups and metrics of a chart which is one aggregation; None for others and for what `draw` refuses."""
    dimensions, metrics = list(dict.fromkeys(c.dimensions)), list(c.metrics) or ["COUNT"]
    n = {"kpi": (0, 99), "pie": (1, 99)}.get(kind, (1, 2) if kind in PLAIN else None)
    try:
        parsed = [parse_metric(m) for m in metrics]
    except ValueError:
        return None
    named = {*dimensions, *[column for _, column in parsed if column]}
    if n is None or not n[0] <= len(dimensions) <= n[1] or any(name == "MEDIAN" for name, _ in parsed) or named - set(df.columns):
        return None
    return {"kpi": ([], metrics), "pie": (dimensions[:1], [*metrics[:1], "COUNT"])}.get(kind, (dimensions, metrics))


def _grouped(df: DataFrame, asked: Mapping[int, tuple[Chart, str]], scale: int | None) -> tuple[DataFrame | None, dict[int, int]]:
    """The points of all charts which are one aggregation, from a single one, and how many each has.

    If it fails nothing comes back: the charts are then computed alone, so that one does not spoil the others.
    """
    requests = {i: r for i, (c, kind) in asked.items() if (r := _request(df, c, kind)) is not None}
    if len(requests) < 2:
        return None, {}
    try:
        found = charts.grouped(df, list(requests.values()), scale)
        found = replace(found, rows=materialize(found.rows, "chart-groups"))
        parts = []
        for i, (dimensions, metrics) in requests.items():
            c, kind = asked[i]
            rows = found.of(dimensions, metrics)
            drawn = _slices(rows, dimensions[0], metrics[0] if c.metrics else None) if kind == "pie" else points_of(rows, dimensions)
            parts.append(drawn.select(F.lit(i).alias("ordinal"), F.lit(c.chart_id).alias("chart_id"), "label", "series", "value"))
        points_ = materialize(reduce(DataFrame.unionByName, parts), "chart-points")
        n = {r["ordinal"]: r["count"] for r in points_.groupBy("ordinal").count().collect()}
    except FAILURES:
        return None, {}
    # A metric of an empty table is a row as well: such cards are computed alone.
    counts = {i: n.get(i, 0) for i in requests if n.get(i) or asked[i][1] != "kpi"}
    return points_.drop("ordinal"), counts


def _slices(rows: DataFrame, name: str, metric: str | None) -> DataFrame:
    value = quoted(charts.metric_alias(metric)).cast("double") if metric else F.lit(None).cast("double")
    size = F.coalesce(F.nullif(value, F.lit(0.0)), F.nullif(F.col("count"), F.lit(0)).cast("double"), F.lit(1.0))
    return rows.select(label(quoted(name)).alias("label"), F.lit("share").alias("series"), size.alias("value"))


def draw(
    df: DataFrame, columns: DataFrame, c: Chart, kind: str, scale: int | None = None, order_by: Sequence[str] = (),
    fraction: float | None = None,
) -> DataFrame:
    """The points (label, series, value) of one chart of the given kind."""
    known = set(df.columns)
    asked = [*c.dimensions, *[col for m in c.metrics if (col := parse_metric(m)[1])]]
    if missing := [n for n in dict.fromkeys(asked) if n not in known]:
        raise ValueError(f"no column {', '.join(missing)}")
    dimensions, metrics = list(dict.fromkeys(c.dimensions)), list(c.metrics)
    numbers = list(dict.fromkeys(col for m in metrics if (col := parse_metric(m)[1])))
    if kind == "kpi":
        return points_of(charts.chart(df, [], metrics or ["COUNT"], scale), [])
    if kind == "histogram":
        found = charts.histogram(df, (dimensions + numbers)[0])
        return found.select(F.col("bin").cast("string").alias("label"), F.lit("n").alias("series"), F.col("n").cast("double").alias("value"))
    if kind == "box":
        value = (numbers or dimensions)[0]
        by = [d for d in dimensions if d != value]
        found = charts.box(df, value, by)
        name = F.concat_ws(" / ", *[label(quoted(b)) for b in by]) if by else F.lit(value)
        cells = F.array(*[F.struct(F.lit(s).alias("series"), F.col(s).cast("double").alias("value")) for s in BOX_SERIES])
        return found.select(name.alias("label"), F.explode(cells).alias("p")).select("label", "p.*")
    if kind == "scatter":
        x, y = (dimensions + numbers)[:2]
        found = charts.scatter(df, x, y, fraction)
        return found.select(label(quoted(x)).alias("label"), F.lit(y).alias("series"), point_value(quoted(y), found.schema[y].dataType).alias("value"))
    if kind == "correlation":
        typed = {r["name"]: r["type"] for r in columns.select("name", "type").collect()}
        found = charts.correlations(df, [n for n in (dimensions + numbers or df.columns) if typed.get(n) == "numeric"])
        return found.select(F.col("x").alias("label"), F.col("y").alias("series"), F.col("correlation").alias("value"))
    if kind == "table":
        keys = list(order_by) or df.columns
        found = df.select(*dict.fromkeys([*keys, *(dimensions + numbers or df.columns)]))
        return points(charts.table_panel(found, keys)).select("label", "series", "value")
    if kind == "pie":
        found = charts.pie(df, dimensions[0], metrics[0] if metrics else None, scale)
        return found.select("label", F.lit("share").alias("series"), "value")
    if kind in PLAIN:
        if not 1 <= len(dimensions) <= 2:
            raise ValueError(f"a {kind} chart has one or two dimensions, not {len(dimensions)}")
        return points_of(charts.chart(df, dimensions, metrics or ["COUNT"], scale), dimensions)
    raise ValueError(f"no chart type {kind!r}")


def points_of(result: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """A row per group and metric; the second dimension, where there is one, names the series."""
    values = result.columns[len(dimensions):]
    name = label(quoted(dimensions[0])) if dimensions else None
    cells = [
        F.struct(
            (name if dimensions else F.lit(v)).alias("label"),
            (label(quoted(dimensions[1])) if len(dimensions) > 1 else F.lit(v)).alias("series"),
            point_value(quoted(v), result.schema[v].dataType).alias("value"),
        )
        for v in values
    ]
    return result.select(F.explode(F.array(*cells)).alias("p")).select("p.*")

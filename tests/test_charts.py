
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkboard.operators import advise, ask, charts, dashboards, shape
from sparkboard.operators.charts import Chart
from sparkboard.operators.profile import profile
from sparkboard.operators.quantiles import group_values, quantiles


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- quantiles and box plots --------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """Most rows in one group, most of them one value; a heavy tail; a null group; nulls and NaN."""
    ids = spark.range(6000)
    return ids.select(
        F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "cold").alias("g"),
        F.when(F.col("id") % 3 == 0, F.lit(7.0))
        .when(F.col("id") % 97 == 1, F.lit(None))
        .when(F.col("id") % 89 == 1, F.lit(float("nan")))
        .otherwise(F.exp((F.col("id") % 501) / 5.0) - 50).alias("v"),
    )


def brute(df, p, midpoint=False):
    per_group = {}
    for g, v in df.collect():
        if v is not None and v == v:
            per_group.setdefault(g, []).append(v)
    method = "hazen" if midpoint else "linear"
    return {g: [float(np.quantile(vs, q, method=method)) for q in p] for g, vs in per_group.items()}


@pytest.mark.parametrize("ranked_at_once", [1, 10, 700, 100_000])
@pytest.mark.parametrize("method", ["linear", "midpoint"])
def test_quantiles_equal_brute_force(skewed, ranked_at_once, method):
    p = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    values = group_values(skewed, F.col("v"), [F.col("g")])
    got = {r["g0"]: [r[f"q{i}"] for i in range(len(p))] for r in quantiles(values, p, method, ranked_at_once).collect()}
    want = brute(skewed, p, method == "midpoint")
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-12)


def test_quantiles_of_infinite_values(spark):
    df = spark.createDataFrame([(v,) for v in [float("-inf"), -1e300, 1.0, 2.0, 1e300, float("inf")]], "v double")
    found = quantiles(group_values(df, F.col("v"), []), (0.4, 0.6), ranked_at_once=1).head()
    assert (found["q0"], found["q1"]) == (1.0, 2.0)


def test_box(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 100.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = charts.box(df, "v").head().asDict()
    assert row == {"n": 9, "min": 1.0, "low_whisker": 1.0, "q1": 3.0, "median": 5.0, "q3": 7.0,
                   "high_whisker": 8.0, "max": 100.0, "outliers": 1}
    assert charts.box(df, "v", method="midpoint").head()["q1"] == np.quantile(values, 0.25, method="hazen")
    assert charts.box(df.filter("v < 0"), "v").collect() == []


def test_medians_in_charts(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", None), (None, 4.0), (None, 6.0)], "g string, v double")
    got = {r["g"]: (r["median_v"], r["count"]) for r in charts.chart(df, ["g"], ["MEDIAN(v)", "COUNT"]).collect()}
    assert got == {"a": (2.0, 3), "b": (None, 1), None: (5.0, 2)}
    assert charts.chart(df, [], ["MEDIAN(v)"]).head()[0] == 4.0


def test_names_with_dots_and_blanks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "`g.x y` string, `v.w` double")
    assert rows(charts.chart(df, ["g.x y"], ["SUM(v.w)", "MEDIAN(v.w)"])) == [("a", 4.0, 2.0)]
    assert rows(charts.bar(df, "g.x y", "COUNT")) == [("a", 2)]
    assert rows(ask.grouped(df, "g.x y", "v.w", scale=1)) == [("a", Decimal("4.0"))]
    assert rows(ask.top_rows(df, "v.w", "v.w", 1)) == [(3.0,)]
    assert rows(ask.extreme_group(df, "g.x y", "v.w", "max")) == [("a", 3.0)]


# --- other charts -------------------------------------------------------------------------------


@pytest.mark.parametrize("metric,parsed", [
    ("AVG(revenue)", ("AVG", "revenue")), ("count", ("COUNT", None)), ("COUNT(*)", ("COUNT", None)),
    ("revenue", ("SUM", "revenue")), ("median( x )", ("MEDIAN", "x")),
])
def test_parse_metric(metric, parsed):
    assert charts.parse_metric(metric) == parsed


def test_unknown_aggregate_is_refused():
    with pytest.raises(ValueError, match="unknown aggregate"):
        charts.parse_metric("MODE(x)")


def test_metric_column(spark):
    df = spark.createDataFrame([("AVG(a)", "a"), ("a", "a"), ("SUM(a", "SUM(a"), ("f(g(x))", "g(x")], "m string, want string")
    assert df.filter(charts.metric_column(F.col("m")) != F.col("want")).count() == 0


def test_pie_shares_sum_to_one_and_zero_falls_through(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 6.0), (None, None)], "g string, v double")
    got = {r["label"]: r["value"] for r in charts.pie(df, "g", "SUM(v)").collect()}
    assert got == {"a": 2.0, "b": 6.0, "Unknown": 1.0}
    assert sum(r["share"] for r in charts.pie(df, "g", "SUM(v)").collect()) == pytest.approx(1)


def test_histogram_counts_every_value_once(spark):
    df = spark.range(1001).select(F.when(F.col("id") < 1000, F.col("id")).alias("v"))
    got = charts.histogram(df, "v", 7).collect()
    assert sum(r["n"] for r in got) == 1000 and len(got) == 7
    assert [r["n"] for r in got] == [143, 143, 143, 142, 143, 143, 143]
    assert charts.histogram(df.filter("v is null"), "v").collect() == []


def test_histogram_of_one_value_and_with_gaps(spark):
    df = spark.createDataFrame([(5,), (5,)], "v int")
    assert [r["n"] for r in charts.histogram(df, "v", 3).collect()] == [2, 0, 0]
    gaps = spark.createDataFrame([(0,), (10,)], "v int")
    assert [r["n"] for r in charts.histogram(gaps, "v", 5).orderBy("bin").collect()] == [1, 0, 0, 0, 1]


def test_scatter_drops_incomplete_pairs_and_samples_by_key(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0)], "k int, x double, y double")
    assert rows(charts.scatter(df, "x", "y")) == [(1.0, 2.0)]
    many = spark.range(20000).select(F.col("id").alias("k"), F.col("id").alias("x"), F.col("id").alias("y"))
    part = charts.scatter(many, "x", "y", 0.1, ["k"])
    assert 1700 < part.count() < 2300
    assert rows(part.orderBy("x")) == rows(charts.scatter(many.repartition(7), "x", "y", 0.1, ["k"]).orderBy("x"))


def test_correlations(spark):
    df = spark.range(50).select(F.col("id").alias("a"), (-F.col("id")).alias("b"), (F.col("id") % 7).alias("c"))
    got = {(r["x"], r["y"]): r["correlation"] for r in charts.correlations(df, ["a", "b", "c"]).collect()}
    assert len(got) == 9 and got["a", "b"] == pytest.approx(-1) and got["a", "a"] == pytest.approx(1)
    assert got["a", "c"] == got["c", "a"]


def test_kpi_change_skips_missing_periods(spark):
    df = spark.sql("select * from values (date'2024-01-05', 1), (date'2024-01-09', 2), (date'2024-03-01', 3), "
                   "(date'2024-04-01', 3), (date'2024-05-01', 1) as t(d, v)")
    got = [(r["value"], r["previous_value"], r["change_type"]) for r in charts.kpi_change(df, "d", "SUM(v)").orderBy("period").collect()]
    assert got == [(3, None, "neutral"), (3, 3, "neutral"), (3, 3, "neutral"), (1, 3, "negative")]


def test_table_panel_counts_all_rows(spark):
    got = charts.table_panel(spark.range(120), ["id"]).collect()
    assert len(got) == 50 and {r["total_rows"] for r in got} == {120}


def test_wide_heatmap(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "p string, q string, v int")
    got = {r["q"]: (r["a"], r["b"]) for r in charts.heatmap_wide(df, "p", "q", "SUM(v)").collect()}
    assert got == {"x": (1, 3), "y": (2, None)}
    assert charts.heatmap_wide(df, "p", "q", values=["b"]).columns == ["q", "b"]


def test_histogram_leaves_out_what_has_no_place(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, "nan", "inf", "-inf")], "x double")
    assert [r["n"] for r in charts.histogram(df, "x", 4).orderBy("bin").collect()] == [1, 1, 1, 1]


def test_hours_are_a_grain(spark):
    df = spark.sql("select timestamp'2024-01-01 10:05:00' t, 1 x union all select timestamp'2024-01-01 10:55:00', 2 union all select timestamp'2024-01-01 11:00:00', 4")
    assert [r["sum_x"] for r in charts.line(df, "t", ["SUM(x)"], "hour").collect()] == [3, 4]
    got = charts.kpi_change(df, "t", "SUM(x)", "hour").orderBy("period").collect()
    assert [(r["value"], r["change"]) for r in got] == [(3, None), (4, 1)]
    with pytest.raises(ValueError, match="grain"):
        charts.line(df, "t", ["SUM(x)"], "minute")


def test_columns_may_be_named_like_results(spark):
    df = spark.createDataFrame([("a", 1, "2024-01-05", 5), ("b", 2, "2024-02-05", 6)], "count string, value int, period string, slice int")
    assert sorted(r["value"] for r in charts.pie(df, "count").collect()) == [1.0, 1.0]
    assert sorted(r["value"] for r in charts.pie(df, "count", "SUM(value)").collect()) == [1.0, 2.0]
    assert sorted(r["value"] for r in charts.pie(df, "count", "MEDIAN(slice)").collect()) == [5.0, 6.0]
    got = charts.kpi_change(df, "period", "SUM(value)", "month").orderBy("period").collect()
    assert [(r["value"], r["previous_value"]) for r in got] == [(1, None), (2, 1)]


def test_dashboard_of_every_type(spark):
    df = spark.createDataFrame([(k % 3, f"g{k % 2}", float(k), k) for k in range(30)], "a int, g string, x double, k int")
    specs = [
        Chart("bar", "bar", ("g",), ("SUM(x)",)), Chart("two", "bar", ("g", "a")), Chart("line", "line", ("k",), ("MAX(x)",)),
        Chart("pie", "pie", ("g",)), Chart("hist", "histogram", ("x",)), Chart("box", "box", ("g",), ("x",)),
        Chart("scatter", "scatter", ("a", "k")), Chart("corr", "correlation", ()), Chart("kpi", "kpi", (), ("COUNT", "AVG(x)")),
        Chart("table", "table", ("g",)), Chart("none", "bar", ()), Chart("ghost", "line", ("ghost", "k")), Chart("odd", "sankey", ("g",)),
        Chart("text", "kpi", (), ("SUM(g)",)),
    ]
    board = dashboards.dashboard(df, profile(df), specs, order_by=["k"])
    status = {r["chart_id"]: r["status"] for r in board.status.collect()}
    assert {k for k, v in status.items() if v == "skipped"} == {"none"}
    assert {k for k, v in status.items() if v == "failed"} == {"ghost", "odd", "text"}
    counts = {r["chart_id"]: r["count"] for r in board.points.groupBy("chart_id").count().collect()}
    assert counts == {"bar": 2, "two": 6, "line": 30, "pie": 2, "hist": 20, "box": 16, "scatter": 30, "corr": 9, "kpi": 2, "table": counts["table"]}
    assert counts == {r["chart_id"]: r["row_count"] for r in board.status.where("status = 'success'").collect()}


def test_grouped_charts_share_one_scan(spark, sf001):
    lines = spark.read.parquet(f"{sf001}/lineitem.parquet")
    sets = [["l_returnflag"], ["l_linestatus"], ["l_returnflag", "l_linestatus"], ["l_linenumber"], ["l_suppkey"], []]
    metrics = ["SUM(l_quantity)", "AVG(l_discount)", "COUNT"]
    found = charts.grouped(lines, [(s, metrics) for s in sets], 2)
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    for s in sets:
        assert sorted(map(repr, found.of(s, metrics).collect())) == sorted(map(repr, charts.chart(lines, s, metrics, 2).collect()))


def test_grouped_charts_know_nulls_from_totals(spark):
    df = spark.createDataFrame([(None, "x", 1), ("a", None, 2), ("a", "x", 4)], "g string, `s.t` string, v int")
    found = charts.grouped(df, [(["g"], ["SUM(v)"]), (["g", "s.t"], ["SUM(v)"]), ([], ["SUM(v)"]), (["v"], ["SUM(v)"])])
    assert sorted(map(repr, rows(found.of(["g"], ["SUM(v)"])))) == ["('a', 6)", "(None, 1)"]
    assert len(found.of(["g", "s.t"], ["SUM(v)"]).collect()) == 3
    assert rows(found.of([], ["SUM(v)"])) == [(7,)]
    assert sorted(rows(found.of(["v"], ["SUM(v)"]))) == [(1, 1), (2, 2), (4, 4)]


def test_charts_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, v double")
    specs = [Chart("k", "kpi", (), ("COUNT", "SUM(v)")), Chart("b", "bar", ("g",), ("SUM(v)",)), Chart("p", "pie", ("g",))]
    board = dashboards.dashboard(df, profile(df), specs)
    assert {r["chart_id"]: r["row_count"] for r in board.status.collect()}["k"] == 2
    assert board.points.where("chart_id = 'b'").count() == 0


def test_scatter_of_a_dashboard_can_keep_a_part(spark):
    df = spark.range(10_000).selectExpr("id x", "id * 2 y")
    board = dashboards.dashboard(df, profile(df), [Chart("s", "scatter", ("x", "y"))], fraction=0.1)
    assert 800 < board.points.count() < 1200


def test_advice_on_a_schema_with_a_repeated_name(spark):
    df = spark.sql("select 'pie' chart_type, array('a') dimensions, array('a') metrics, array(named_struct('name', 'a', 'type', 'text'), named_struct('name', 'a', 'type', 'numeric')) columns")
    assert advise.advise(df).head()["skip_reason"] is None


def test_dashboard(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), (None, "x", 5.0)], "g string, s string, v double")
    got = set(rows(charts.dashboard(df, [
        Chart("one", "bar", ("g",), ("SUM(v)", "MEDIAN(v)")), Chart("two", "stacked_bar", ("g", "s")),
        Chart("three", "pie", ("g",)),
    ])))
    assert got == {
        ("one", "a", "sum_v", 4.0), ("one", "Unknown", "sum_v", 5.0), ("one", "a", "median_v", 2.0),
        ("one", "Unknown", "median_v", 5.0), ("two", "a", "x", 1.0), ("two", "a", "y", 1.0),
        ("two", "Unknown", "x", 1.0), ("three", "a", "count", 2.0), ("three", "Unknown", "count", 1.0),
    }
    with pytest.raises(ValueError, match="no column ghost"):
        charts.dashboard(df, [Chart("x", "bar", ("ghost",))])


# --- result shaping -----------------------------------------------------------------------------


def test_points(spark):
    two = spark.createDataFrame([("a", None), (None, "2.5"), ("c", "x")], "g string, v string")
    assert rows(shape.points(two)) == [("a", "v", 0.0), ("Unknown", "v", 2.5), ("c", "v", 0.0)]
    many = spark.sql("select 'l' g, 1 a, true b, date'2024-01-01' c, timestamp_ntz'2024-01-01 10:00:00' d")
    assert rows(shape.points(many)) == [
        ("l", "a", 1.0, None), ("l", "b", 1.0, None), ("l", "c", 0.0, None), ("l", "d", None, "2024-01-01 10:00:00"),
    ]
    assert rows(shape.points(spark.sql("select cast(null as int) v"))) == [(0,)]
    assert rows(shape.points(spark.sql("select date'2024-01-01' v"))) == [("2024-01-01",)]


@pytest.mark.parametrize("n_rows,n_columns,kind", [
    (0, 2, "empty"), (1, 1, "kpi"), (5, 1, "table"), (1, 2, "table"), (5, 2, "chart"), (5, 3, "table"),
])
def test_result_shape(spark, n_rows, n_columns, kind):
    df = spark.range(n_rows).select(*[F.col("id").alias(f"c{i}") for i in range(n_columns)])
    assert shape.result_shape(df) == kind
    sizes = spark.createDataFrame([(n_rows, n_columns)], "r int, c int")
    assert sizes.select(shape.shape_of(F.col("r"), F.col("c"))).head()[0] == kind


def test_dashboard_summary(spark):
    df = spark.createDataFrame([("success",)] * 5 + [("skipped",), ("failed",)], "status string")
    assert rows(shape.dashboard_summary(df)) == [(7, 5, 1, 1, True)]
    assert shape.dashboard_summary(df.union(df)).head()["too_few"] is False


# --- advice -------------------------------------------------------------------------------------

SCHEMA = [("region", "categorical"), ("note", "text"), ("revenue", "numeric"), ("units", "numeric"), ("day", "datetime")]
ADVICE = [
    ("bar", ["region"], ["SUM(revenue)"], "bar", None),
    ("Bar", ["region", "note"], [], "heatmap", None),
    ("bar", ["region", "region"], [], "bar", None),
    ("bar", [], [], "bar", "Bar chart requires at least 1 dimension"),
    ("pie", [], ["COUNT"], "pie", "Pie chart requires at least 1 dimension"),
    ("pie", ["units"], ["COUNT"], "pie", None),
    ("scatter", ["units", "revenue"], [], "scatter", None),
    ("scatter", ["units", "region"], [], "bar", None),
    ("scatter", ["units"], [], "bar", None),
    ("scatter", [], [], "bar", None),
    ("area", ["region", "note"], [], "heatmap", None),
    ("area", ["region", "note", "day"], [], "heatmap", None),
    ("line", ["region", "note"], [], "bar", None),
    ("line", ["day", "region"], [], "line", None),
    ("line", ["units"], [], "line", None),
    ("line", ["ghost"], [], "line", "Line chart requires at least a time or numeric x-axis"),
    ("area", [], [], "area", "Area chart requires at least a time or numeric x-axis"),
    ("heatmap", ["region", "note"], [], "heatmap", None),
    ("heatmap", ["region"], ["COUNT"], "bar", None),
    ("heatmap", ["region"], [], "heatmap", "Heatmap requires 2 categorical dimensions (found 1)"),
    ("heatmap", ["units"], ["COUNT"], "heatmap", "Heatmap requires 2 categorical dimensions (found 0)"),
    ("histogram", [], [], "histogram", None),
    ("bar", ["region"], ["region", "note", "region"], "bar",
     "Non-aggregated metrics must be numeric (non-numeric: ['region', 'note'])"),
    ("bar", ["region"], ["revenue", "ghost", "count(region)", " MAX(note)"], "bar", None),
    ("bar", ["region"], ["COUNTRY(region)"], "bar",
     "Non-aggregated metrics must be numeric (non-numeric: ['region'])"),
    ("bar", ["region", "note"], ["day"], "bar",
     "Non-aggregated metrics must be numeric (non-numeric: ['day'])"),
]


def test_advice(spark):
    specs = spark.createDataFrame(
        [(i, t, d, m, SCHEMA) for i, (t, d, m, *_) in enumerate(ADVICE)],
        "i int, chart_type string, dimensions array<string>, metrics array<string>, "
        "columns array<struct<name:string,type:string>>",
    )
    got = {r["i"]: (r["corrected_type"], r["skip_reason"]) for r in advise.advise(specs).collect()}
    assert [got[i] for i in range(len(ADVICE))] == [(t, s) for *_, t, s in ADVICE]

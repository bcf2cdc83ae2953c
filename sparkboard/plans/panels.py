"""Result shaping, chart data and chart advice on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkboard.operators import advise, ask, charts, dashboards as boards, route, shape, sketches
from sparkboard.operators.charts import Chart
from sparkboard.operators.profile import profile
from sparkboard.operators.quantiles import attach
from sparkboard.plans.common import Query, average_sql, money, on, table, text_list, total_sql
from sparkboard.sources.scratch import materialize

# --- result shaping ---------------------------------------------------------------------------


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def points_of_groups(orders: DataFrame) -> DataFrame:
    """Label and value per customer; every tenth customer has lost its key, some lost the value."""
    lost = orders.select(
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"),
    )
    return shape.points(ask.grouped(lost, "o_custkey", "o_totalprice", scale=2))


def points_of_series(lines: DataFrame) -> DataFrame:
    """Several series per ship date, one of them a text and one a date."""
    result = lines.groupBy("l_shipdate").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("l_linenumber").alias("lines"),
        F.when(F.count(F.lit(1)) > 200, "many").otherwise("few").alias("flag"),
        F.max(F.col("l_shipdate").cast("date")).alias("day"),
        F.max("l_quantity").cast("string").alias("quantity"),
    )
    return shape.points(result)


def result_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's lines as a result: as many rows as lines, as many columns as its status says."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    per_order = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    width = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return orders.join(per_order, "o_orderkey", "left").select(
        "o_orderkey", shape.shape_of(F.coalesce("n", F.lit(0)), width).alias("shape")
    )


def status_points(spark: SparkSession, folder: str) -> DataFrame:
    """Data points per chart of one dashboard."""
    return shape.point_counts(charts.dashboard(table(spark, folder, "lineitem"), LINE_CHARTS, 2))


# --- charts -----------------------------------------------------------------------------------

LINE_CHARTS = (
    Chart("flags", "bar", ("l_returnflag",), ("SUM(l_extendedprice)", "COUNT")),
    Chart("cells", "heatmap", ("l_returnflag", "l_linestatus"), ("SUM(l_quantity)",)),
    Chart("trend", "line", ("l_shipdate",), ("MAX(l_quantity)",)),
    Chart("lines", "pie", ("l_linenumber",), ("COUNT",)),
)
DASHBOARD_SQL = f"""
    SELECT 'flags' AS chart_id, l_returnflag AS label, 'sum_l_extendedprice' AS series,
        {total_sql('l_extendedprice')} AS value FROM lineitem GROUP BY l_returnflag
    UNION ALL SELECT 'flags', l_returnflag, 'count', CAST(COUNT(*) AS DOUBLE) FROM lineitem
        GROUP BY l_returnflag
    UNION ALL SELECT 'cells', l_returnflag, l_linestatus, {total_sql('l_quantity')} FROM lineitem
        GROUP BY l_returnflag, l_linestatus
    UNION ALL SELECT 'trend', CAST(l_shipdate AS VARCHAR), 'max_l_quantity', MAX(l_quantity)
        FROM lineitem GROUP BY l_shipdate
    UNION ALL SELECT 'lines', CAST(l_linenumber AS VARCHAR), 'count', CAST(COUNT(*) AS DOUBLE)
        FROM lineitem GROUP BY l_linenumber
"""

HISTOGRAM_SQL = """
    WITH lim AS (SELECT MIN({c}) AS lo, MAX({c}) AS hi FROM {t}),
    placed AS (
        SELECT CAST(CASE WHEN hi > lo THEN least(floor(({c} - lo) / ((hi - lo) / {n})), {n} - 1) ELSE 0 END
            AS INTEGER) AS bin FROM {t}, lim WHERE {c} IS NOT NULL
    ), counted AS (SELECT bin, COUNT(*) AS n FROM placed GROUP BY bin)
    SELECT CAST(i AS INTEGER) AS bin, ROUND(lo + i * ((hi - lo) / {n}), 6) AS low,
        ROUND(lo + (i + 1) * ((hi - lo) / {n}), 6) AS high, coalesce(n, 0) AS n
    FROM range({n}) AS r(i) CROSS JOIN lim LEFT JOIN counted ON counted.bin = r.i
"""

BOX_SQL = """
    WITH quartiles AS (
        SELECT {g} AS g, COUNT({c}) AS n, MIN({c}) AS lo, MAX({c}) AS hi,
            quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median,
            quantile_cont({c}, 0.75) AS q3
        FROM {t} GROUP BY 1
    ), fences AS (
        SELECT *, q1 - 1.5 * (q3 - q1) AS low_fence, q3 + 1.5 * (q3 - q1) AS high_fence FROM quartiles
    )
    SELECT {shown} n, lo AS min, MIN(CASE WHEN inside THEN v END) AS low_whisker, ROUND(q1, 6) AS q1,
        ROUND(median, 6) AS median, ROUND(q3, 6) AS q3,
        MAX(CASE WHEN inside THEN v END) AS high_whisker, hi AS max,
        CAST(COUNT(*) FILTER (WHERE NOT inside) AS BIGINT) AS outliers
    FROM (SELECT f.*, x.{c} AS v, x.{c} BETWEEN low_fence AND high_fence AS inside
          FROM fences AS f JOIN {t} AS x ON {same}) AS placed
    GROUP BY g, n, lo, hi, q1, median, q3
"""

CORRELATED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
CORRELATION_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, ROUND(corr({a}, {b}), 8) AS correlation FROM lineitem"
    for a in CORRELATED for b in CORRELATED
)

# The components of the embeddings, as columns.
COMPONENTS = 64
COMPONENTS_SQL = "SELECT UNNEST([{}], recursive := true) FROM embeddings".format(", ".join(
    f"{{'x': 'e{a}', 'y': 'e{b}', 'correlation': ROUND(corr(embedding[{a}]::DOUBLE, embedding[{b}]::DOUBLE), 6) + 0.0}}"
    for a in range(1, COMPONENTS + 1) for b in range(a, COMPONENTS + 1)
))


def component_correlations(spark: SparkSession, folder: str) -> DataFrame:
    """Correlations of the embeddings' components, each pair of columns once."""
    rows = table(spark, folder, "embeddings").select(*[F.get("embedding", i).alias(f"e{i + 1}") for i in range(COMPONENTS)])
    found = charts.correlations(rows, rows.columns)
    number = lambda name: F.substring(name, 2, 9).cast("int")
    return found.where(number("x") <= number("y")).select("x", "y", (F.round("correlation", 6) + 0.0).alias("correlation"))


def boxes_of_months(spark: SparkSession, folder: str) -> DataFrame:
    """Box plots by return flag, merged from sketches of months: exact ends, and whether the quartiles keep their error."""
    rows = table(spark, folder, "lineitem").withColumn("month", F.date_trunc("month", "l_shipdate"))
    months = materialize(sketches.box_sketches(rows, "l_extendedprice", ["l_returnflag", "month"]), "box-sketches")
    boxes = sketches.approximate_boxes(sketches.merged_sketches(months, ["l_returnflag"]), ["l_returnflag"])
    boxes = materialize(boxes, "boxes")
    found = attach(boxes, sketches.rank_errors(rows, "l_extendedprice", boxes, ["l_returnflag"]), ["l_returnflag"])
    return found.select("l_returnflag", "n", "min", "max", (F.col("error") < 0.01).alias("within_error"))


ALL_METRICS = (
    "COUNT", "SUM(l_extendedprice)", "AVG(l_extendedprice)", "MIN(l_extendedprice)",
    "MAX(l_extendedprice)", "MEDIAN(l_extendedprice)", "STDDEV(l_quantity)", "VARIANCE(l_quantity)",
    "COUNT(l_tax)",
)

CHANGE_SQL = """
    WITH periods AS (
        SELECT {keys} CAST(date_trunc('{grain}', {date}) AS DATE) AS period, {value} AS value
        FROM {table} GROUP BY ALL
    ), backward AS (SELECT *, lag(value) OVER ({part} ORDER BY period) AS previous_value FROM periods)
    SELECT {keys} CAST(period AS VARCHAR) AS period, CAST(value AS DOUBLE) AS value,
        CAST(previous_value AS DOUBLE) AS previous_value, CAST(value - previous_value AS DOUBLE) AS change,
        CASE WHEN value > previous_value THEN 'positive' WHEN value < previous_value THEN 'negative'
             ELSE 'neutral' END AS change_type
    FROM backward
"""

# --- chart specifications ---------------------------------------------------------------------

# Specifications are made of the rows of `part`: which type, which dimensions and which metrics
# follows from the key, the size and the brand of each.
SPEC_TYPES = ("bar", "Scatter", "AREA", "line", "heatmap", "pie", "histogram", "stacked_bar", "box")
SPEC_DIMENSIONS = (
    "", "p_type", "p_type|p_brand", "p_size|p_retailprice", "p_size", "p_type|p_type", "ghost",
    "p_name|p_brand|p_type", "p_size|p_type", "ghost|p_brand", "p_partkey|p_size|ghost",
)
SPEC_METRICS = (
    "", "AVG(p_retailprice)", "p_retailprice", "p_name", "COUNT", "sum(p_size)|p_brand",
    "LOG(p_type)|p_name|p_name", "ghost", "count(p_name)|MEDIAN (p_name)", " MAX(p_name)",
)


def _choice(place: str, texts: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(texts))
    return f"CASE ({place}) % {len(texts)} {cases} END"


SPEC_TYPE = _choice("p_partkey", SPEC_TYPES)
SPEC_DIMS = _choice("p_size", SPEC_DIMENSIONS)
SPEC_METRIC = _choice("length(p_name) + p_size + p_partkey", SPEC_METRICS)


def chart_specs(spark: SparkSession, folder: str) -> DataFrame:
    """One chart specification per part, each with the schema of the table of parts."""
    parts = table(spark, folder, "part")
    spelled = parts.select(
        "p_partkey", "p_brand", F.expr(SPEC_TYPE).alias("chart_type"),
        F.expr(SPEC_DIMS).alias("d"), F.expr(SPEC_METRIC).alias("m"),
    )
    return spelled.select(
        "p_partkey", "p_brand", "chart_type",
        text_list("d").alias("dimensions"), text_list("m").alias("metrics"),
    ).withColumn("columns", route.schema_array(profile(parts)))


def advised(spark: SparkSession, folder: str) -> DataFrame:
    return advise.advise(chart_specs(spark, folder)).select(
        "p_partkey", "chart_type", "corrected_type", "skip_reason"
    )


def dimension_classes(spark: SparkSession, folder: str) -> DataFrame:
    """How many distinct dimensions of each class a specification has, and its wrong metrics."""
    specs = chart_specs(spark, folder)
    types = advise.column_types(F.col("dimensions"), F.col("columns"))
    wrong = advise.wrong_metrics(F.col("metrics"), F.col("columns"))
    return specs.withColumn("t", types).select(
        "p_partkey",
        F.size(F.filter("t", lambda t: t["type"].isin("categorical", "text"))).alias("categories"),
        F.size(F.filter("t", lambda t: t["type"] == "numeric")).alias("numbers"),
        F.size(F.filter("t", lambda t: t["type"] == "unknown")).alias("unknown"),
        F.array_join(wrong, ",").alias("wrong_metrics"),
    )


def dashboards(spark: SparkSession, folder: str) -> DataFrame:
    """One dashboard per brand: charts skipped by the rules, failed for a missing column, drawn."""
    specs = advise.advise(chart_specs(spark, folder))
    foreign = F.exists(
        advise.column_types(F.flatten(F.array("dimensions", F.transform("metrics", charts.metric_column))),
                            F.col("columns")),
        lambda t: t["name"] == "ghost",
    )
    status = F.when(F.col("skip_reason").isNotNull(), "skipped").when(foreign, "failed").otherwise("success")
    return shape.dashboard_summary(specs.withColumn("status", status), "p_brand")


BOARD = (
    Chart("flags", "bar", ("l_returnflag",), ("SUM(l_extendedprice)", "COUNT")),
    Chart("cells", "bar", ("l_returnflag", "l_linestatus"), ("SUM(l_quantity)",)),
    Chart("slices", "PIE", ("l_linestatus",)),
    Chart("days", "line", ("l_shipdate",), ("SUM(l_quantity)",)),
    Chart("spread", "histogram", ("l_quantity",)),
    Chart("pairs", "correlation", (), ("l_quantity", "l_discount")),
    Chart("whole", "kpi", (), ("SUM(l_quantity)", "COUNT", "MAX(l_discount)")),
    Chart("middle", "kpi", (), ("MEDIAN(l_extendedprice)",)),
    Chart("no axis", "area", (), ("COUNT",)),
    Chart("no number", "pie", ("l_returnflag",), ("l_linestatus",)),
    Chart("no column", "pie", ("ghost",), ("COUNT",)),
    Chart("no such type", "radar", ("l_returnflag",), ("COUNT",)),
)


def board(spark: SparkSession, folder: str) -> boards.Dashboard:
    """A dashboard over line items: charts that are drawn, corrected, skipped and failed."""
    lines = table(spark, folder, "lineitem")
    return boards.dashboard(lines, profile(lines), BOARD, 2)


def board_points(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(board(spark, folder).points, 6, "value")


def board_summary(spark: SparkSession, folder: str) -> DataFrame:
    return shape.dashboard_summary(board(spark, folder).status)


BOARD_POINTS_SQL = f"""
    WITH limits AS (SELECT MIN(l_quantity) AS lo, (MAX(l_quantity) - MIN(l_quantity)) / 20 AS w FROM lineitem),
    points AS (
        SELECT 'flags' AS chart_id, l_returnflag AS label, 'sum_l_extendedprice' AS series,
            {total_sql('l_extendedprice')} AS value FROM lineitem GROUP BY 2
        UNION ALL SELECT 'flags', l_returnflag, 'count', COUNT(*) FROM lineitem GROUP BY 2
        UNION ALL SELECT 'cells', l_returnflag, l_linestatus, {total_sql('l_quantity')} FROM lineitem GROUP BY 2, 3
        UNION ALL SELECT 'slices', l_linestatus, 'share', COUNT(*) FROM lineitem GROUP BY 2
        UNION ALL SELECT 'days', CAST(l_shipdate AS VARCHAR), 'sum_l_quantity', {total_sql('l_quantity')} FROM lineitem GROUP BY 2
        UNION ALL SELECT 'spread', CAST(b AS VARCHAR), 'n', COUNT(l_quantity)
            FROM range(20) AS bins(b) LEFT JOIN (
                SELECT l_quantity, least(CAST(floor((l_quantity - lo) / w) AS INTEGER), 19) AS slot FROM lineitem, limits
            ) AS placed ON slot = b GROUP BY 2
        UNION ALL SELECT 'pairs', x, y, CASE WHEN x = y THEN 1.0 ELSE c END FROM
            (SELECT corr(l_quantity, l_discount) AS c FROM lineitem) AS found,
            (VALUES ('l_quantity'), ('l_discount')) AS left_one(x), (VALUES ('l_quantity'), ('l_discount')) AS right_one(y)
        UNION ALL SELECT 'whole', 'sum_l_quantity', 'sum_l_quantity', {total_sql('l_quantity')} FROM lineitem
        UNION ALL SELECT 'whole', 'count', 'count', COUNT(*) FROM lineitem
        UNION ALL SELECT 'whole', 'max_l_discount', 'max_l_discount', MAX(l_discount) FROM lineitem
        UNION ALL SELECT 'middle', 'median_l_extendedprice', 'median_l_extendedprice', median(l_extendedprice) FROM lineitem
    )
    SELECT chart_id, label, series, round(CAST(value AS DOUBLE), 6) AS value FROM points
"""
BOARD_STATUS_SQL = """
    SELECT * FROM (VALUES
        ('flags', 'bar', 'bar', 'success'), ('cells', 'bar', 'heatmap', 'success'), ('slices', 'PIE', 'pie', 'success'),
        ('days', 'line', 'line', 'success'), ('spread', 'histogram', 'histogram', 'success'),
        ('pairs', 'correlation', 'correlation', 'success'), ('whole', 'kpi', 'kpi', 'success'), ('middle', 'kpi', 'kpi', 'success'),
        ('no axis', 'area', 'area', 'skipped'), ('no number', 'pie', 'pie', 'skipped'),
        ('no column', 'pie', 'pie', 'failed'), ('no such type', 'radar', 'radar', 'failed')
    ) AS t(chart_id, chart_type, corrected_type, status)
"""


def metric_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The columns metrics are about, over all specifications."""
    metrics = chart_specs(spark, folder).select(F.explode("metrics").alias("metric"))
    return metrics.groupBy("metric", charts.metric_column(F.col("metric")).alias("column")).agg(
        F.count(F.lit(1)).alias("n")
    )


_PART_NUMBERS = "('p_partkey', 'p_size', 'p_retailprice')"
_PART_CATEGORIES = "('p_name', 'p_brand', 'p_type')"
_BARE = "(upper(trim(m)) NOT SIMILAR TO '(COUNT|SUM|AVG|MIN|MAX|MEDIAN|STDDEV|VARIANCE)(\\(.*)?')"
_COLUMN = "CASE WHEN contains(m, '(') THEN regexp_extract(m, '\\(([^)]+)\\)', 1) ELSE m END"
SPECS_SQL = f"""
    WITH spelled AS (
        SELECT p_partkey, p_brand, {SPEC_TYPE} AS chart_type, {SPEC_DIMS} AS d, {SPEC_METRIC} AS ms FROM part
    ), dims AS (
        SELECT p_partkey, COUNT(DISTINCT CASE WHEN d IN {_PART_CATEGORIES} THEN d END) AS categories,
            COUNT(DISTINCT CASE WHEN d IN {_PART_NUMBERS} THEN d END) AS numbers,
            COUNT(DISTINCT CASE WHEN d = 'ghost' THEN d END) AS unknown, COUNT(*) AS n_dims
        FROM (SELECT p_partkey, unnest(string_split(d, '|')) AS d FROM spelled) AS u
        WHERE d <> '' GROUP BY 1
    ), mets AS (
        SELECT p_partkey, COUNT(*) AS n_metrics, COUNT(CASE WHEN c = 'ghost' THEN 1 END) AS ghosts,
            string_agg(c, ',' ORDER BY place)
                FILTER (WHERE bare AND c IN {_PART_CATEGORIES} AND place = first_place) AS wrong
        FROM (SELECT *, MIN(CASE WHEN bare THEN place END) OVER (PARTITION BY p_partkey, c) AS first_place
              FROM (SELECT p_partkey, place, {_BARE} AS bare, {_COLUMN} AS c
                    FROM (SELECT p_partkey, unnest(string_split(ms, '|')) AS m,
                              generate_subscripts(string_split(ms, '|'), 1) AS place FROM spelled) AS u
                    WHERE m <> '') AS named) AS placed
        GROUP BY 1
    ), specs AS (
        SELECT s.p_partkey, p_brand, chart_type, lower(chart_type) AS k,
            coalesce(categories, 0) AS cats, coalesce(numbers, 0) AS nums, coalesce(unknown, 0) AS unknown,
            coalesce(n_dims, 0) AS n_dims, coalesce(n_metrics, 0) AS n_metrics,
            coalesce(ghosts, 0) AS ghosts, wrong
        FROM spelled AS s LEFT JOIN dims USING (p_partkey) LEFT JOIN mets USING (p_partkey)
    ), ruled AS (
        SELECT *,
            CASE WHEN wrong IS NOT NULL THEN k
                 WHEN k = 'bar' AND cats >= 2 THEN 'heatmap'
                 WHEN k = 'scatter' AND (cats > 0 OR nums < 2) THEN 'bar'
                 WHEN k = 'area' AND cats = 2 THEN 'heatmap'
                 WHEN k IN ('line', 'area') AND cats > 0 THEN 'bar'
                 WHEN k = 'heatmap' AND cats = 1 AND n_metrics > 0 THEN 'bar'
                 ELSE k END AS corrected_type,
            CASE WHEN wrong IS NOT NULL THEN 'Non-aggregated metrics must be numeric (non-numeric: ['''
                    || replace(wrong, ',', ''', ''') || '''])'
                 WHEN k IN ('line', 'area') AND cats = 0 AND nums = 0
                    THEN upper(k[1]) || k[2:] || ' chart requires at least a time or numeric x-axis'
                 WHEN k = 'heatmap' AND cats < 2 AND NOT (cats = 1 AND n_metrics > 0)
                    THEN 'Heatmap requires 2 categorical dimensions (found ' || cats || ')'
                 WHEN k = 'bar' AND n_dims = 0 THEN 'Bar chart requires at least 1 dimension'
                 WHEN k = 'pie' AND n_dims = 0 THEN 'Pie chart requires at least 1 dimension'
            END AS skip_reason
        FROM specs
    )
"""

QUERIES = {
    "dashboard_points": Query("C1 R3 R6", board_points, BOARD_POINTS_SQL),
    "dashboard_status": Query(
        "C1 A1 R6 R7", lambda spark, folder: board(spark, folder).status.select(
            "chart_id", "chart_type", "corrected_type", "status", "row_count"),
        f"""SELECT s.*, n AS row_count FROM ({BOARD_STATUS_SQL}) AS s LEFT JOIN (
                SELECT chart_id, COUNT(*) AS n FROM ({BOARD_POINTS_SQL}) AS p GROUP BY 1) AS c USING (chart_id)""",
    ),
    "dashboard_outcome": Query(
        "R6", board_summary,
        f"""SELECT COUNT(*) AS total_charts, COUNT(CASE WHEN status = 'success' THEN 1 END) AS successful_charts,
                COUNT(CASE WHEN status = 'skipped' THEN 1 END) AS skipped_charts,
                COUNT(CASE WHEN status = 'failed' THEN 1 END) AS failed_charts,
                COUNT(CASE WHEN status = 'success' THEN 1 END) < 6 AS too_few
            FROM ({BOARD_STATUS_SQL}) AS s, (SELECT 1 FROM lineitem LIMIT 1) AS any_line""",
    ),
    "points_of_groups": Query(
        "R1 R2", on("orders", points_of_groups),
        f"""SELECT CASE WHEN o_custkey % 10 = 0 THEN 'Unknown' ELSE CAST(o_custkey AS VARCHAR) END AS label,
                'o_totalprice' AS series,
                coalesce(CAST(SUM(CASE WHEN o_orderstatus <> 'P' THEN {money('o_totalprice')} END)
                    AS DOUBLE), 0.0) AS value
            FROM orders GROUP BY 1""",
    ),
    "points_of_series": Query(
        "R2 R3", on("lineitem", points_of_series),
        """WITH s AS (SELECT CAST(l_shipdate AS VARCHAR) AS label, CAST(COUNT(*) AS DOUBLE) AS n,
               CAST(SUM(l_linenumber) AS DOUBLE) AS lines, MAX(l_quantity) AS quantity
               FROM lineitem GROUP BY l_shipdate)
           SELECT label, 'n' AS series, n AS value FROM s
           UNION ALL SELECT label, 'lines', lines FROM s
           UNION ALL SELECT label, 'flag', 0.0 FROM s
           UNION ALL SELECT label, 'day', 0.0 FROM s
           UNION ALL SELECT label, 'quantity', quantity FROM s""",
    ),
    "points_with_times": Query(
        "R2 R3", on("orders", lambda o: shape.points(
            o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), F.count(F.lit(1)).alias("n")))),
        """SELECT CAST(o_custkey AS VARCHAR) AS label, 'last' AS series, CAST(NULL AS DOUBLE) AS value,
               CAST(MAX(o_orderdate) AS VARCHAR) AS value_text FROM orders GROUP BY o_custkey
           UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'n', CAST(COUNT(*) AS DOUBLE), NULL
           FROM orders GROUP BY o_custkey""",
    ),
    "single_value": Query(
        "R4", on("lineitem", lambda li: shape.single_value(ask.total(li, "l_extendedprice", scale=2))),
        f"SELECT {total_sql('l_extendedprice')} AS value FROM lineitem",
    ),
    "result_shapes": Query(
        "R5", result_sizes,
        """WITH sized AS (
               SELECT o_orderkey, COUNT(l_orderkey) AS n, MIN(o_orderstatus) AS s
               FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
           SELECT o_orderkey, CASE WHEN n = 0 THEN 'empty' WHEN s = 'F' AND n = 1 THEN 'kpi'
               WHEN s = 'O' AND n > 1 THEN 'chart' ELSE 'table' END AS shape FROM sized""",
    ),
    "dashboard_summaries": Query(
        "R6 A1", dashboards,
        SPECS_SQL + """
        SELECT p_brand, COUNT(*) AS total_charts,
            COUNT(*) FILTER (WHERE skip_reason IS NULL AND unknown + ghosts = 0) AS successful_charts,
            COUNT(*) FILTER (WHERE skip_reason IS NOT NULL) AS skipped_charts,
            COUNT(*) FILTER (WHERE skip_reason IS NULL AND unknown + ghosts > 0) AS failed_charts,
            COUNT(*) FILTER (WHERE skip_reason IS NULL AND unknown + ghosts = 0) < 6 AS too_few
        FROM ruled GROUP BY p_brand""",
    ),
    "point_counts": Query(
        "R7", status_points,
        f"SELECT chart_id, COUNT(*) AS row_count FROM ({DASHBOARD_SQL}) AS points GROUP BY chart_id",
    ),
    "dashboard": Query(
        "C1", on("lineitem", lambda li: charts.dashboard(li, LINE_CHARTS, 2)), DASHBOARD_SQL
    ),
    "chart_all_metrics": Query(
        "C1 C2 C3", on("lineitem", lambda li: rounded(
            charts.chart(li, ["l_returnflag", "l_linestatus"], ALL_METRICS, 2), 6,
            "median_l_extendedprice", "stddev_l_quantity", "variance_l_quantity")),
        f"""SELECT l_returnflag, l_linestatus, COUNT(*) AS count,
                {total_sql('l_extendedprice')} AS sum_l_extendedprice,
                {average_sql('l_extendedprice')} AS avg_l_extendedprice,
                MIN(l_extendedprice) AS min_l_extendedprice, MAX(l_extendedprice) AS max_l_extendedprice,
                ROUND(quantile_cont(l_extendedprice, 0.5), 6) AS median_l_extendedprice,
                ROUND(stddev_samp(l_quantity), 6) AS stddev_l_quantity,
                ROUND(var_samp(l_quantity), 6) AS variance_l_quantity, COUNT(l_tax) AS count_l_tax
            FROM lineitem GROUP BY 1, 2""",
    ),
    "metric_columns": Query(
        "C3", metric_columns,
        f"""SELECT m AS metric, {_COLUMN} AS column, COUNT(*) AS n
            FROM (SELECT unnest(string_split({SPEC_METRIC}, '|')) AS m FROM part) AS u
            WHERE m <> '' GROUP BY 1, 2""",
    ),
    "bar": Query(
        "C4", on("orders", lambda o: charts.bar(o, "o_orderpriority", "AVG(o_totalprice)", 2)),
        f"""SELECT o_orderpriority, {average_sql('o_totalprice')} AS avg_o_totalprice
            FROM orders GROUP BY 1""",
    ),
    "bar_of_one_column": Query(
        "C4", on("lineitem", lambda li: charts.bar(li, "l_linenumber")),
        """SELECT l_linenumber, CAST(SUM(l_linenumber) AS BIGINT) AS sum_l_linenumber
           FROM lineitem GROUP BY 1""",
    ),
    "stacked_bar": Query(
        "C5", on("orders", lambda o: charts.stacked_bar(
            o, "o_orderpriority", "o_orderstatus", "SUM(o_totalprice)", 2)),
        f"""SELECT o_orderpriority, o_orderstatus, {total_sql('o_totalprice')} AS sum_o_totalprice
            FROM orders GROUP BY 1, 2""",
    ),
    "line": Query(
        "C6", on("orders", lambda o: charts.line(
            o, "o_orderdate", ["SUM(o_totalprice)", "COUNT"], "month", 2)),
        f"""SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS o_orderdate,
                {total_sql('o_totalprice')} AS sum_o_totalprice, COUNT(*) AS count
            FROM orders GROUP BY 1""",
    ),
    "line_over_numbers": Query(
        "C6", on("part", lambda p: charts.line(p, "p_size", ["MAX(p_retailprice)"])),
        "SELECT p_size, MAX(p_retailprice) AS max_p_retailprice FROM part GROUP BY 1",
    ),
    "pie": Query(
        "C7", on("part", lambda p: rounded(
            charts.pie(p, "p_type", "SUM(p_retailprice)", 2), 10, "share")),
        f"""WITH slices AS (SELECT p_type AS label, {total_sql('p_retailprice')} AS value FROM part GROUP BY 1)
            SELECT label, value, ROUND(value / (SELECT SUM(value) FROM slices), 10) AS share FROM slices""",
    ),
    "pie_of_counts": Query(
        "C7", on("documents", lambda d: rounded(charts.pie(d, "lang"), 10, "share")),
        """WITH slices AS (SELECT lang AS label, CAST(COUNT(*) AS DOUBLE) AS value FROM documents GROUP BY 1)
           SELECT label, value, ROUND(value / (SELECT SUM(value) FROM slices), 10) AS share FROM slices""",
    ),
    "scatter": Query(
        "C8", on("lineitem", lambda li: charts.scatter(li, "l_quantity", "l_extendedprice")),
        """SELECT l_quantity, l_extendedprice FROM lineitem
           WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL""",
    ),
    "histogram": Query(
        "C9", on("lineitem", lambda li: rounded(
            charts.histogram(li, "l_extendedprice", 20), 6, "low", "high")),
        HISTOGRAM_SQL.format(t="lineitem", c="l_extendedprice", n=20),
    ),
    "histogram_of_lengths": Query(
        "C9", on("documents", lambda d: rounded(charts.histogram(d, "n_chars", 50), 6, "low", "high")),
        HISTOGRAM_SQL.format(t="documents", c="n_chars", n=50),
    ),
    "box": Query(
        "C10", on("lineitem", lambda li: rounded(
            charts.box(li, "l_extendedprice", ["l_returnflag"]), 6, "q1", "median", "q3")),
        BOX_SQL.format(t="lineitem", c="l_extendedprice", g="l_returnflag",
                       shown="g AS l_returnflag,", same="f.g = x.l_returnflag"),
    ),
    "box_with_outliers": Query(
        "C10", on("documents", lambda d: rounded(
            charts.box(d, "n_chars"), 6, "q1", "median", "q3")),
        BOX_SQL.format(t="(SELECT CAST(n_chars AS DOUBLE) AS n_chars FROM documents)", c="n_chars",
                       g="0", shown="", same="TRUE"),
    ),
    "heatmap": Query(
        "C11", on("lineitem", lambda li: charts.heatmap(
            li, "l_returnflag", "l_linenumber", "AVG(l_extendedprice)", 2)),
        f"""SELECT l_returnflag, l_linenumber, {average_sql('l_extendedprice')} AS avg_l_extendedprice
            FROM lineitem GROUP BY 1, 2""",
    ),
    "heatmap_wide": Query(
        "C11", on("lineitem", lambda li: charts.heatmap_wide(
            li, "l_returnflag", "l_linenumber", "SUM(l_quantity)", scale=2)),
        f"""SELECT l_linenumber, {", ".join(
            f"CAST(SUM(CASE WHEN l_returnflag = '{v}' THEN {money('l_quantity')} END) AS DOUBLE) AS {v}"
            for v in "ANR")} FROM lineitem GROUP BY 1""",
    ),
    "correlations": Query(
        "C12", on("lineitem", lambda li: rounded(charts.correlations(li, CORRELATED), 8, "correlation")),
        CORRELATION_SQL,
    ),
    "boxes_of_months": Query(
        "C10", boxes_of_months,
        """SELECT l_returnflag, COUNT(l_extendedprice) AS n, MIN(l_extendedprice) AS min, MAX(l_extendedprice) AS max, true AS within_error
           FROM lineitem GROUP BY l_returnflag""",
    ),
    "component_correlations": Query("C12", component_correlations, COMPONENTS_SQL),
    "kpi_card": Query(
        "C13", on("orders", lambda o: charts.kpi_card(o, "o_totalprice", 2)),
        f"""SELECT {total_sql('o_totalprice')} AS primary_value, {average_sql('o_totalprice')} AS average,
                MAX(o_totalprice) AS max, MIN(o_totalprice) AS min FROM orders""",
    ),
    "kpi_change": Query(
        "C14", on("orders", lambda o: charts.kpi_change(o, "o_orderdate", "SUM(o_totalprice)", scale=2)),
        CHANGE_SQL.format(keys="", part="", grain="month", date="o_orderdate", table="orders",
                          value=f"SUM({money('o_totalprice')})"),
    ),
    "kpi_change_by_group": Query(
        "C14", on("events", lambda e: charts.kpi_change(e, "ts", "COUNT", "day", ["event_type"])),
        CHANGE_SQL.format(keys="event_type,", part="PARTITION BY event_type", grain="day", date="ts",
                          table="events", value="COUNT(*)").replace(
            "CAST(value AS DOUBLE)", "value").replace("CAST(previous_value AS DOUBLE)", "previous_value"
        ).replace("CAST(value - previous_value AS DOUBLE)", "value - previous_value"),
    ),
    "table_panel": Query(
        "C15", on("part", lambda p: charts.table_panel(p, ["p_partkey"])),
        """SELECT *, (SELECT COUNT(*) FROM part) AS total_rows FROM part ORDER BY p_partkey LIMIT 50""",
    ),
    "chart_advice": Query(
        "A1 A2 A3", advised,
        SPECS_SQL + "SELECT p_partkey, chart_type, corrected_type, skip_reason FROM ruled",
    ),
    "dimension_classes": Query(
        "A2 A3", dimension_classes,
        SPECS_SQL + """SELECT p_partkey, CAST(cats AS INTEGER) AS categories, CAST(nums AS INTEGER) AS numbers,
            CAST(unknown AS INTEGER) AS unknown, coalesce(wrong, '') AS wrong_metrics FROM specs""",
    ),
}

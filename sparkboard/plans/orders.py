"""The order of ordered results, single listings, and questions from their words to the shape of the answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sparkboard.operators import ask, charts, convo, route, shape
from sparkboard.operators.profile import profile
from sparkboard.plans.common import Query, average_sql, money, on, table, total_sql
from sparkboard.sources.csv import with_row_number
from sparkboard.sources.scratch import local_table, materialize


def _positions(operator: str, result: DataFrame, key: str) -> DataFrame:
    """Where each row of an ordered result stands, from the files it was written to in that order."""
    keys = result.select(F.expr(key).cast("string").alias("key"))
    return with_row_number(materialize(keys, "ordered"), "position").select(F.lit(operator).alias("operator"), "position", "key")


def result_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Groups by falling measure, series by rising time, bars and lines by their axis."""
    orders = table(spark, folder, "orders")
    return reduce(DataFrame.unionByName, [
        _positions("grouped", ask.grouped(orders, "o_orderpriority", "o_totalprice", scale=2), "o_orderpriority"),
        _positions("groups_with_total", ask.groups_with_total(orders, "o_custkey", "o_totalprice", scale=2), "o_custkey"),
        _positions("time_series", ask.time_series(orders, "o_orderdate", "o_totalprice", "month", 2), "o_orderdate"),
        _positions("bar", charts.bar(orders, "o_orderstatus", "AVG(o_totalprice)", 2), "o_orderstatus"),
        _positions("line", charts.line(orders, "o_orderdate", ["COUNT"], "week"), "o_orderdate"),
    ])


def listing_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions by owner, the latest first; messages by session, in time."""
    sessions = convo.sessions_of(
        table(spark, folder, "orders"), owner_column="o_custkey", updated="o_orderdate", id="o_orderkey", columns=("o_orderkey",)
    )
    messages = convo.messages_of(table(spark, folder, "conversations"), session_column="conv_id", created="turn", columns=("turn",))
    return _positions("sessions", sessions, "o_orderkey").unionByName(
        _positions("messages", messages, "concat(conv_id, ':', turn)")
    )


def own_listings(spark: SparkSession, folder: str) -> DataFrame:
    """The sessions of one owner and the messages of one session."""
    sessions = convo.sessions_of(
        table(spark, folder, "orders"), 7, owner_column="o_custkey", updated="o_orderdate", id="o_orderkey", columns=("o_orderkey",)
    )
    messages = convo.messages_of(
        table(spark, folder, "conversations"), 3, session_column="conv_id", created="turn", columns=("turn", "role")
    )
    return _positions("sessions", sessions, "o_orderkey").unionByName(_positions("messages", messages, "concat(turn, role)"))


def hours(spark: SparkSession, folder: str) -> DataFrame:
    """An hourly series of a measure with values that are none."""
    events = table(spark, folder, "events").withColumn(
        "value", F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    )
    found = charts.line(events, "ts", ["SUM(value)", "COUNT", "AVG(value)"], "hour", 2)
    return found.select(
        F.col("ts").cast("string").alias("ts"), F.col("sum_value").cast("double").alias("sum_value"), "count",
        F.col("avg_value").cast("double").alias("avg_value"),
    )


# A question for each template, and one for none.
ASKED = (
    ("show me a few rows", "first_rows", "table"),
    ("tell me the day o custkey was highest", "extreme_date", "table"),
    ("total o totalprice", "total", "kpi"),
    ("how many o orderstatus", "distinct_count", "kpi"),
    ("number of purchases", "row_count", "kpi"),
    ("mean o custkey", "average", "kpi"),
    ("o custkey by o orderstatus", "grouped", "chart"),
    ("best o custkey", "top_rows", "table"),
    ("list all o orderpriority with o custkey", "groups_with_total", "chart"),
    ("o custkey over time", "time_series", "chart"),
    ("why are parcels late?", None, None),
)
ANSWERS = T.StructType([
    T.StructField("question", T.StringType(), False), T.StructField("template", T.StringType()),
    T.StructField("status", T.StringType(), False), T.StructField("shape", T.StringType()), T.StructField("n_rows", T.LongType()),
    T.StructField("value", T.DoubleType()),
])


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Questions on the orders, answered: the template, what became of it, shape and size of the result, the sum of its points."""
    orders = table(spark, folder, "orders")
    columns = profile(orders)
    rows = []
    for question, *_ in ASKED:
        a = route.ask_dataset(orders, columns, question, "o_orderkey")
        value = None
        if a.result is not None:
            value = shape.points(a.result).agg(F.round(F.sum("value").cast("double"), 2)).first()[0]
        rows.append((question, a.template, a.status, a.shape, a.n_rows, value))
    return local_table(spark, rows, ANSWERS)


def _answers_sql() -> str:
    sizes = {
        "first_rows": "SELECT least(10, COUNT(*)) FROM orders", "extreme_date": "SELECT 1", "top_rows": "SELECT least(5, COUNT(*)) FROM orders",
        "grouped": "SELECT COUNT(DISTINCT o_orderstatus) FROM orders", "time_series": "SELECT COUNT(DISTINCT o_orderdate) FROM orders",
        "groups_with_total": "SELECT COUNT(DISTINCT o_orderpriority) FROM orders",
    }
    values = {
        "first_rows": f"SELECT SUM(o_custkey + {money('o_totalprice')}) FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10) AS first",
        "extreme_date": "SELECT MAX(v) FROM (SELECT SUM(o_custkey) AS v FROM orders GROUP BY CAST(o_orderdate AS DATE)) AS days",
        "total": f"SELECT SUM({money('o_totalprice')}) FROM orders", "distinct_count": "SELECT COUNT(DISTINCT o_orderstatus) FROM orders",
        "row_count": "SELECT COUNT(*) FROM orders", "average": "SELECT AVG(o_custkey) FROM orders", "top_rows": "SELECT MAX(o_custkey) FROM orders",
    }
    quote = lambda v: "NULL" if v is None else f"'{v}'"
    return " UNION ALL ".join(
        f"""SELECT '{q}' AS question, CAST({quote(t)} AS VARCHAR) AS template, '{'answered' if t else 'unknown'}' AS status,
            CAST({quote(s)} AS VARCHAR) AS shape, CAST(({sizes.get(t, 'SELECT 1') if t else 'SELECT NULL'}) AS BIGINT) AS n_rows,
            ROUND(CAST(({values.get(t, 'SELECT SUM(o_custkey) FROM orders') if t else 'SELECT NULL'}) AS DOUBLE), 2) AS value"""
        for q, t, s in ASKED
    )


def _placed_sql(operator: str, key: str, order: str, source: str) -> str:
    return f"""SELECT '{operator}' AS operator, row_number() OVER (ORDER BY {order}) AS position,
        CAST({key} AS VARCHAR) AS key FROM ({source}) AS result"""


QUERIES = {
    "result_orders": Query(
        "Q6 Q8 Q9 C4 C6", result_orders,
        " UNION ALL ".join([
            _placed_sql("grouped", "o_orderpriority", "v DESC, o_orderpriority",
                        f"SELECT o_orderpriority, {total_sql('o_totalprice')} AS v FROM orders GROUP BY 1"),
            _placed_sql("groups_with_total", "o_custkey", "v DESC, o_custkey",
                        f"SELECT o_custkey, {total_sql('o_totalprice')} AS v FROM orders GROUP BY 1"),
            _placed_sql("time_series", "m", "m", "SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders"),
            _placed_sql("bar", "o_orderstatus", "o_orderstatus", "SELECT DISTINCT o_orderstatus FROM orders"),
            _placed_sql("line", "w", "w", "SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS w FROM orders"),
        ]),
    ),
    "listing_orders": Query(
        "H1 H2", listing_orders,
        _placed_sql("sessions", "o_orderkey", "o_custkey, o_orderdate DESC, o_orderkey", "SELECT * FROM orders") + " UNION ALL "
        + _placed_sql("messages", "conv_id || ':' || turn", "conv_id, turn", "SELECT * FROM conversations"),
    ),
    "own_listings": Query(
        "H1 H2", own_listings,
        _placed_sql("sessions", "o_orderkey", "o_orderdate DESC, o_orderkey", "SELECT * FROM orders WHERE o_custkey = 7") + " UNION ALL "
        + _placed_sql("messages", "turn || role", "turn", "SELECT * FROM conversations WHERE conv_id = 3"),
    ),
    "hourly_series": Query(
        "C6 Q2 Q5", hours,
        f"""SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS ts, {total_sql('value')} AS sum_value, MAX(n) AS count,
                {average_sql('value')} AS avg_value
            FROM (SELECT date_trunc('hour', ts) AS ts, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS value,
                      COUNT(*) OVER (PARTITION BY date_trunc('hour', ts)) AS n FROM events) AS hours GROUP BY 1""",
    ),
    "answers": Query("N1 R5 Q0 Q1 Q2 Q3 Q4 Q5 Q6 Q7 Q8 Q9", answers, _answers_sql()),
    "scatter_of_a_part": Query(
        "C8", on("lineitem", lambda li: charts.scatter(li, "l_quantity", "l_discount", 1.0, ["l_orderkey", "l_linenumber"])),
        "SELECT l_quantity, l_discount FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL",
    ),
}

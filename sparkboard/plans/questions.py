"""Question templates and routing on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkboard.operators import ask, route
from sparkboard.operators.profile import profile
from sparkboard.plans.common import Query, average_sql, on, plain, table, total_sql

PRICE_BY_PRIORITY = f"""
    SELECT o_orderpriority, {total_sql('o_totalprice')} AS {{}}
    FROM orders GROUP BY o_orderpriority
"""

# Questions people ask of a table of orders, with numbers from the row they are made of.
QUESTION_TEXTS = (
    "'  Show ' || cast(o_custkey as string) || ' rows '",
    "'display the first rows'",
    "'list ' || cast(o_orderkey as string) || ' browsers'",
    "'tell me the day o totalprice was highest'",
    "'in which year was the lowest amount taken'",
    "'at what time was o custkey at its maximum'",
    "'total of o totalprice, please'",
    "'total o totalprice by o orderpriority'",
    "'sum of o custkey and o totalprice'",
    "'how many o orderstatus'",
    "'revenue by country'",
    "'number of accounts'",
    "'average o totalprice'",
    "'mean o totalprice by o orderstatus'",
    "'o totalprice by o orderstatus'",
    "'sum o totalprice by o orderpriority'",
    "'AVG price by o orderpriority of o custkey'",
    "'top ' || cast(o_custkey as string) || '000000' || ' o orderkey by o totalprice'",
    "'best o totalprice'",
    "'list all o orderpriority with o totalprice'",
    "'o totalprice over time'",
    "'o totalprice trend by month ' || o_orderstatus",
    "'o custkey by date'",
    "'why is order ' || cast(o_orderkey as string) || ' late?'",
)
QUESTION = "CASE o_orderkey % {} {} END".format(
    len(QUESTION_TEXTS), " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(QUESTION_TEXTS))
)


def order_questions(spark: SparkSession, folder: str) -> DataFrame:
    """One question per order, each with the schema of the table it asks."""
    orders = table(spark, folder, "orders")
    asked = orders.select("o_orderkey", F.expr(QUESTION).alias("question"))
    return asked.withColumn("columns", route.schema_array(profile(orders)))


def route_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return route.route_to(orders.select("o_orderkey", F.expr(QUESTION).alias("question")), profile(orders))


def route_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Every message of every conversation as a question on the table of conversations."""
    messages = table(spark, folder, "conversations")
    asked = messages.withColumn("columns", route.schema_array(profile(messages)))
    return route.route(asked, "text").select(
        "conv_id", "turn", "template", "dimension", "metric", "aggregate", "highest", "n"
    )


def question_words(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers, mentions and the raw-rows test on questions and on whole messages."""
    asked = order_questions(spark, folder).select("question")
    said = table(spark, folder, "conversations").select(F.col("text").alias("question"))
    q = F.lower("question")
    return asked.unionAll(said).groupBy(
        route.wants_raw_rows(F.col("question")).alias("raw_rows"),
        route.first_number(q).alias("number"),
        route.mentions(q, F.lit("o_totalprice")).alias("names_price"),
    ).agg(F.count(F.lit(1)).alias("n"))


def _any(words: tuple[str, ...], q: str = "q") -> str:
    return "(" + " OR ".join(f"contains({q}, '{w}')" for w in words) + ")"


def _first(names: tuple[str, ...]) -> str:
    tests = " ".join(f"WHEN contains(q, '{n.replace('_', ' ')}') THEN '{n}'" for n in names)
    return f"CASE {tests} END"


def routing_sql(
    source: str,
    keys: str,
    every: tuple[str, ...],
    numeric: tuple[str, ...],
    categorical: tuple[str, ...],
    date: str | None,
    likely: str,
) -> str:
    """The routing rules as SQL over the questions `text` of a source."""
    no = "FALSE" if date is None else "TRUE"
    category = _first(categorical) if categorical else "NULL"
    digits = "ltrim(regexp_extract(q, '[0-9]+'), '0')"
    return f"""
    WITH words AS (
        SELECT {keys}, lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS q FROM ({source}) AS asked
    ), roles AS (
        SELECT {keys}, q, {_first(every)} AS any_named, {_first(numeric)} AS metric_named,
            {category} AS category_named,
            CASE WHEN NOT regexp_matches(q, '[0-9]') THEN NULL
                 WHEN {digits} = '' THEN 0
                 ELSE coalesce(TRY_CAST({digits} AS BIGINT), 9223372036854775807) END AS number
        FROM words
    ), chosen AS (
        SELECT *, CASE
            WHEN {_any(('list', 'show', 'display'))} AND contains(' ' || q, ' row') THEN 'first_rows'
            WHEN {no} AND {_any(('which', 'what', 'tell'))}
                AND {_any(('highest', 'max', 'lowest', 'min'))}
                AND {_any(('date', 'day', 'month', 'year', 'time'))} THEN 'extreme_date'
            WHEN {_any(('total', 'sum of'))} AND metric_named IS NOT NULL THEN 'total'
            WHEN {_any(('how many', 'count', 'number of'))} THEN
                CASE WHEN any_named IS NULL THEN 'row_count' ELSE 'distinct_count' END
            WHEN {_any(('average', 'avg', 'mean'))} AND metric_named IS NOT NULL THEN 'average'
            WHEN contains(q, ' by ') AND metric_named IS NOT NULL AND category_named IS NOT NULL
                THEN 'grouped'
            WHEN {_any(('top', 'best', 'highest'))} AND metric_named IS NOT NULL THEN 'top_rows'
            WHEN {_any(('list all', 'all regions', 'all products'))} AND metric_named IS NOT NULL
                AND category_named IS NOT NULL THEN 'groups_with_total'
            WHEN {no} AND {_any(('over time', 'trend', 'by date', 'by month'))}
                AND metric_named IS NOT NULL THEN 'time_series'
            END AS template
        FROM roles
    )
    SELECT {keys}, template,
        CASE WHEN template IN ('extreme_date', 'time_series') THEN '{date}'
             WHEN template IN ('distinct_count', 'top_rows') THEN any_named
             WHEN template IN ('grouped', 'groups_with_total') THEN category_named END AS dimension,
        CASE WHEN template = 'extreme_date' THEN coalesce(metric_named, '{likely}')
             WHEN template IN ('total', 'average', 'grouped', 'top_rows', 'groups_with_total',
                               'time_series') THEN metric_named END AS metric,
        CASE WHEN template IN ('extreme_date', 'total', 'groups_with_total', 'time_series') THEN 'sum'
             WHEN template = 'distinct_count' THEN 'count_distinct'
             WHEN template = 'row_count' THEN 'count'
             WHEN template = 'average' THEN 'avg'
             WHEN template = 'grouped' THEN CASE WHEN {_any(('total', 'sum'))} THEN 'sum'
                 WHEN {_any(('average', 'avg', 'mean'))} THEN 'avg'
                 WHEN contains(q, 'count') THEN 'count' ELSE 'sum' END END AS aggregate,
        CASE WHEN template = 'extreme_date' THEN {_any(('highest', 'max'))} END AS highest,
        CAST(CASE WHEN template = 'first_rows' THEN least(greatest(coalesce(number, 10), 1), 100)
             WHEN template = 'extreme_date' THEN 1
             WHEN template = 'top_rows' THEN coalesce(number, 5) END AS BIGINT) AS n
    FROM chosen
    """


ORDER_ROUTING = routing_sql(
    f"SELECT o_orderkey, {QUESTION} AS question, {QUESTION} AS text FROM orders",
    "o_orderkey",
    ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    ("o_orderkey", "o_custkey", "o_totalprice"),
    ("o_orderstatus", "o_orderpriority"),
    "o_orderdate",
    "o_totalprice",
)
MESSAGE_ROUTING = routing_sql(
    "SELECT conv_id, turn, text FROM conversations",
    "conv_id, turn",
    ("conv_id", "turn", "role", "text"),
    ("conv_id", "turn"),
    ("role",),
    None,
    "conv_id",
)

QUERIES = {
    "first_rows": Query(
        "Q0", on("orders", lambda o: ask.first_rows(o, "o_orderkey", 25)),
        """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
               CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority
           FROM orders ORDER BY o_orderkey LIMIT 25""",
    ),
    "date_with_highest_total": Query(
        "Q1", on("orders", lambda o: ask.extreme_date(o, "o_orderdate", "o_totalprice", scale=2)),
        f"""SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate,
                {total_sql('o_totalprice')} AS total_o_totalprice
            FROM orders GROUP BY CAST(o_orderdate AS DATE)
            ORDER BY 2 DESC NULLS LAST, 1 LIMIT 1""",
    ),
    "date_with_lowest_total": Query(
        "Q1", on("events", lambda e: ask.extreme_date(e, "ts", "value", highest=False, scale=2)),
        f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS ts, {total_sql('value')} AS total_value
            FROM events GROUP BY CAST(ts AS DATE) ORDER BY 2 ASC NULLS LAST, 1 LIMIT 1""",
    ),
    "total": Query(
        "Q2", on("lineitem", lambda li: ask.total(li, "l_extendedprice", scale=2)),
        f"SELECT {total_sql('l_extendedprice')} AS total_l_extendedprice FROM lineitem",
    ),
    "distinct_count": Query(
        "Q3", on("lineitem", lambda li: ask.distinct_count(li, "l_partkey")),
        "SELECT COUNT(DISTINCT l_partkey) AS count_l_partkey FROM lineitem",
    ),
    "row_count": Query(
        "Q4", on("lineitem", ask.row_count), "SELECT COUNT(*) AS total_count FROM lineitem"
    ),
    "average": Query(
        "Q5", on("orders", lambda o: ask.average(o, "o_totalprice", scale=2)),
        f"SELECT {average_sql('o_totalprice')} AS avg_o_totalprice FROM orders",
    ),
    "grouped_sum": Query(
        "Q6", on("orders", lambda o: ask.grouped(o, "o_orderpriority", "o_totalprice", scale=2)),
        PRICE_BY_PRIORITY.format("o_totalprice"),
    ),
    "grouped_average": Query(
        "Q6", on("documents", lambda d: ask.grouped(d, "source", "n_chars", "avg")),
        "SELECT source, CAST(SUM(n_chars) AS DOUBLE) / COUNT(n_chars) AS n_chars FROM documents GROUP BY source",
    ),
    "grouped_count": Query(
        "Q6", on("lineitem", lambda li: ask.grouped(li, "l_returnflag", "l_tax", "count")),
        "SELECT l_returnflag, COUNT(l_tax) AS l_tax FROM lineitem GROUP BY l_returnflag",
    ),
    "top_rows": Query(
        "Q7", on("orders", lambda o: ask.top_rows(
            o, "o_orderpriority", "o_totalprice", 10, ["o_orderkey"])),
        """SELECT o_orderpriority, o_totalprice FROM orders
           ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 10""",
    ),
    "top_rows_of_the_metric": Query(
        "Q7", on("lineitem", lambda li: ask.top_rows(
            li, "l_extendedprice", "l_extendedprice", 7, ["l_orderkey", "l_linenumber"])),
        """SELECT l_extendedprice FROM lineitem
           ORDER BY l_extendedprice DESC NULLS FIRST, l_orderkey, l_linenumber LIMIT 7""",
    ),
    "groups_with_total": Query(
        "Q8", on("orders", lambda o: ask.groups_with_total(o, "o_custkey", "o_totalprice", scale=2)),
        f"""SELECT o_custkey, {total_sql('o_totalprice')} AS total_o_totalprice
            FROM orders GROUP BY o_custkey""",
    ),
    "time_series": Query(
        "Q9", on("orders", lambda o: ask.time_series(o, "o_orderdate", "o_totalprice", scale=2)),
        f"""SELECT CAST(o_orderdate AS VARCHAR) AS o_orderdate,
                {total_sql('o_totalprice')} AS total_o_totalprice FROM orders GROUP BY o_orderdate""",
    ),
    "time_series_by_month": Query(
        "Q9", on("lineitem", lambda li: ask.time_series(li, "l_shipdate", "l_quantity", "month", 2)),
        f"""SELECT CAST(CAST(date_trunc('month', l_shipdate) AS DATE) AS VARCHAR) AS l_shipdate,
                {total_sql('l_quantity')} AS total_l_quantity FROM lineitem GROUP BY 1""",
    ),
    "group_with_highest_total": Query(
        "Q10", on("lineitem", lambda li: ask.extreme_group(li, "l_suppkey", "l_extendedprice", scale=2)),
        f"""SELECT l_suppkey, {total_sql('l_extendedprice')} AS sum_l_extendedprice
            FROM lineitem GROUP BY l_suppkey ORDER BY 2 DESC NULLS LAST, 1 LIMIT 1""",
    ),
    "sql_view": Query(
        "E13", lambda spark, folder: plain(ask.sql_view(
            table(spark, folder, "lineitem"),
            """SELECT l_returnflag AS flag, l_linestatus AS status, COUNT(*) AS n,
                      SUM(CAST(l_quantity AS DECIMAL(18,2))) AS quantity
               FROM dataset WHERE l_discount > 0.02 GROUP BY l_returnflag, l_linestatus
               ORDER BY quantity DESC""")),
        f"""SELECT l_returnflag AS flag, l_linestatus AS status, COUNT(*) AS n,
                {total_sql('l_quantity')} AS quantity
            FROM lineitem WHERE l_discount > 0.02 GROUP BY 1, 2""",
    ),
    "route_questions": Query(
        "N1 N2 N3 N4 N5", route_orders,
        f"""SELECT routed.*, {QUESTION} AS question
            FROM ({ORDER_ROUTING}) AS routed JOIN orders USING (o_orderkey)""",
    ),
    "route_messages": Query("N1 N2 N3 N4 N5", route_messages, MESSAGE_ROUTING),
    "question_words": Query(
        "N2 N4 N6", question_words,
        f"""WITH asked AS (
                SELECT {QUESTION} AS question FROM orders UNION ALL SELECT text FROM conversations
            ), read AS (
                SELECT lower(question) AS q, ltrim(regexp_extract(question, '[0-9]+'), '0') AS digits
                FROM asked
            )
            SELECT regexp_matches(q, '\\b(list|show|display)\\b') AND regexp_matches(q, '\\brows?\\b')
                    AS raw_rows,
                CASE WHEN NOT regexp_matches(q, '[0-9]') THEN NULL
                     WHEN digits = '' THEN 0
                     ELSE coalesce(TRY_CAST(digits AS BIGINT), 9223372036854775807) END AS number,
                contains(q, 'o totalprice') AS names_price, COUNT(*) AS n
            FROM read GROUP BY 1, 2, 3""",
    ),
}

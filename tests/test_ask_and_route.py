import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparkboard.operators import ask, route
from sparkboard.operators.profile import profile


@pytest.fixture(scope="module")
def groups(spark):
    day = dt.date
    return spark.createDataFrame(
        [("a", Decimal("1.00"), day(2024, 1, 1)), ("a", None, day(2024, 1, 2)), ("b", None, day(2024, 1, 2)),
         ("c", Decimal("5.00"), None), (None, Decimal("2.00"), day(2024, 2, 1)), ("d", Decimal("5.00"), day(2024, 1, 1))],
        "g string, m decimal(18,2), d date",
    )


@pytest.fixture(scope="module")
def sales(spark):
    rows = [
        ("north", "pen", "f", dt.date(2024, 1, 1), Decimal("10.00"), 1, 4.0),
        ("south", "pen", "m", dt.date(2024, 1, 1), Decimal("20.00"), 2, 3.0),
        ("north", "ink", "f", dt.date(2024, 1, 2), Decimal("5.00"), 3, 5.0),
    ] * 4
    return spark.createDataFrame(
        rows, "region string, product string, gender string, order_date date, revenue decimal(18,2), "
        "units_sold int, satisfaction double"
    ).withColumn("row_number", F.monotonically_increasing_id())


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_nulls_lead_groups_sorted_by_measure(groups):
    assert rows(ask.grouped(groups, "g", "m")) == [
        ("b", None), ("c", Decimal("5.00")), ("d", Decimal("5.00")), (None, Decimal("2.00")), ("a", Decimal("1.00")),
    ]
    assert ask.groups_with_total(groups, "g", "m").columns == ["g", "total_m"]
    assert rows(ask.groups_with_total(groups, "g", "m"))[0] == ("b", None)


def test_nulls_lead_top_rows(groups):
    top = rows(ask.top_rows(groups, "g", "m", 3, ["g"]))
    assert top == [("a", None), ("b", None), ("c", Decimal("5.00"))]
    assert ask.top_rows(groups, "m", "m", 0).collect() == []
    assert ask.top_rows(groups, "m", "m", 2).columns == ["m"]


def test_many_top_rows_do_not_meet_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(ask, "TOP_ROWS_IN_ONE_TASK", 10)
    df = spark.range(5000).repartition(9).select(
        F.col("id").alias("k"), F.when(F.col("id") % 50 > 0, F.col("id") * 7919 % 1009).alias("m")
    )
    want = rows(df.select("k", "m").orderBy(F.desc_nulls_first("m"), "k").limit(2345))
    got = ask.top_rows(df, "k", "m", 2345)
    assert rows(got) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan  # the only single task adds up rows per file


def test_nulls_end_a_time_series(groups):
    series = rows(ask.time_series(groups, "d", "m"))
    assert series[0] == (dt.date(2024, 1, 1), Decimal("6.00")) and series[-1] == (None, Decimal("5.00"))
    assert rows(ask.time_series(groups, "d", "m", "month"))[0] == (dt.date(2024, 1, 1), Decimal("6.00"))
    with pytest.raises(ValueError):
        ask.time_series(groups, "d", "m", "minute")


def test_nulls_never_win_an_extreme(groups):
    assert rows(ask.extreme_date(groups, "d", "m")) == [(dt.date(2024, 1, 1), Decimal("6.00"))]
    assert rows(ask.extreme_date(groups, "d", "m", highest=False)) == [(dt.date(2024, 2, 1), Decimal("2.00"))]
    assert rows(ask.extreme_group(groups, "g", "m", "sum", False)) == [("a", Decimal("1.00"))]


def test_extreme_date_is_the_end_of_the_sorted_series(sales):
    series = rows(ask.time_series(sales, "order_date", "revenue"))
    assert rows(ask.extreme_date(sales, "order_date", "revenue")) == [max(series, key=lambda r: r[1])]


def test_first_rows_are_between_1_and_100(sales):
    assert ask.first_rows(sales, "row_number", 0).count() == 1
    assert ask.first_rows(sales, "row_number", 500).count() == 12
    assert ask.first_rows(sales.sparkSession.range(500), "id", 500).count() == 100


def test_counts_and_averages(groups):
    assert rows(ask.distinct_count(groups, "g")) == [(4,)]
    assert rows(ask.distinct_count(groups, "g", approximate=True)) == [(4,)]
    assert rows(ask.row_count(groups)) == [(6,)]
    assert float(ask.average(groups, "m").head()[0]) == 3.25
    assert ask.total(groups, "m").head()["total_m"] == Decimal("13.00")


def test_text_measures_are_cast_exactly(spark):
    df = spark.createDataFrame([("0.1",), ("0.2",)], "v string")
    assert ask.total(df, "v", scale=1).head()[0] == Decimal("0.3")
    assert abs(ask.total(df, "v").head()[0] - 0.3) < 1e-12


def test_both_ways_of_routing_agree(spark):
    schema = [("revenue", "numeric"), ("region", "categorical"), ("order_date", "datetime"), ("units_sold", "numeric"), ("note", "text")]
    columns = spark.createDataFrame([(i, *c) for i, c in enumerate(schema)], "ordinal int, name string, type string")
    texts = [
        "show 7 rows", "which day had the maximum units sold", "what year was lowest", "total revenue", "how many region", "count all",
        "average units sold", "units sold by region", "top 12 region by revenue", "best", "list all region with revenue",
        "revenue as it went over time", "nothing", "sum of revenue by order date", "mean note by region", None,
    ]
    for kept in (schema, schema[1:2], schema[:1]):
        own = columns.where(F.col("name").isin([n for n, _ in kept]))
        asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, question string")
        one = route.route_to(asked, own).orderBy("i").collect()
        other = route.route(asked.withColumn("columns", route.schema_array(own))).drop("columns").orderBy("i").collect()
        assert one == other
    plan = route.route_to(asked, own)._jdf.queryExecution().executedPlan().toString()
    assert "filter(" not in plan and "lambda" not in plan


def test_numbers_of_any_size(spark):
    texts = ["top 1500000000 x", "top 99999999999 x", "top " + "9" * 30 + " x", "top 007", "none"]
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    got = [r[0] for r in df.select(route.first_number(F.col("q"))).collect()]
    assert got == [1500000000, 99999999999, 2**63 - 1, 7, None]


def test_sql_view_runs_queries_alone_and_leaves_nothing(spark, sales):
    with pytest.raises(Exception):
        ask.sql_view(sales, "drop table if exists anything")
    ask.sql_view(sales, "select * from dataset")
    assert not spark.catalog.tableExists("dataset")


def test_sql_view(sales):
    got = ask.sql_view(sales, "select region, sum(units_sold) n from dataset group by region order by n desc limit 1")
    assert rows(got) == [("north", 16)]


# question -> template, dimension, metric, aggregate, highest, n
ROUTES = [
    ("please list 10 rows of it", ("first_rows", None, None, None, None, 10)),
    ("Show 500 rows", ("first_rows", None, None, None, None, 100)),
    ("display rows", ("first_rows", None, None, None, None, 10)),
    ("show 0 rows", ("first_rows", None, None, None, None, 1)),
    ("show the rowing club", ("first_rows", None, None, None, None, 10)),
    ("show 99999999999999999999 rows", ("first_rows", None, None, None, None, 100)),
    ("rows to list", ("first_rows", None, None, None, None, 10)),
    ("  tell me on what day revenue was highest ", ("extreme_date", "order_date", "revenue", "sum", True, 1)),
    ("in which year were takings lowest", ("extreme_date", "order_date", "revenue", "sum", False, 1)),
    ("what day had the minimum units sold", ("extreme_date", "order_date", "units_sold", "sum", False, 1)),
    ("which year is the maximum and minimum", ("extreme_date", "order_date", "revenue", "sum", True, 1)),
    ("total revenue so far", ("total", None, "revenue", "sum", None, None)),
    ("total revenue by region", ("total", None, "revenue", "sum", None, None)),
    ("total of nothing", (None,) * 6),
    ("how many people bought", ("row_count", None, None, "count", None, None)),
    ("how many region", ("distinct_count", "region", None, "count_distinct", None, None)),
    ("revenue by country", ("distinct_count", "revenue", None, "count_distinct", None, None)),
    ("satisfaction on average", ("average", None, "satisfaction", "avg", None, None)),
    ("Average satisfaction by region", ("average", None, "satisfaction", "avg", None, None)),
    ("mean of gender", (None,) * 6),
    ("revenue, split by region", ("grouped", "region", "revenue", "sum", None, None)),
    ("sum revenue by product", ("grouped", "product", "revenue", "sum", None, None)),
    ("revenue by order date", (None,) * 6),
    ("top 5 shops", (None,) * 6),
    ("top 3 product by revenue", ("grouped", "product", "revenue", "sum", None, None)),
    ("top 3 order date with revenue", ("top_rows", "order_date", "revenue", None, None, 3)),
    ("top revenue", ("top_rows", "revenue", "revenue", None, None, 5)),
    ("top 0 revenue", ("top_rows", "revenue", "revenue", None, None, 0)),
    ("all regions with region revenue", ("groups_with_total", "region", "revenue", "sum", None, None)),
    ("revenue as it went over time", ("time_series", "order_date", "revenue", "sum", None, None)),
    ("units sold trend", ("time_series", "order_date", "units_sold", "sum", None, None)),
    ("hello there", (None,) * 6),
    ("", (None,) * 6),
]


def routed(spark, sales, questions):
    columns = route.schema_array(profile(sales.drop("row_number")))
    table = spark.createDataFrame([(q,) for q in questions], "question string").withColumn("columns", columns)
    return {
        r["question"]: (r["template"], r["dimension"], r["metric"], r["aggregate"], r["highest"], r["n"])
        for r in route.route(table).collect()
    }


def test_routes(spark, sales):
    got = routed(spark, sales, [q for q, _ in ROUTES])
    assert {q: got[q] for q, _ in ROUTES} == dict(ROUTES)


def test_routing_does_not_depend_on_the_other_questions(spark, sales):
    questions = [q for q, _ in ROUTES]
    assert routed(spark, sales, questions[::-1]) == routed(spark, sales, questions)


def test_routing_moves_no_rows(spark, sales):
    columns = route.schema_array(profile(sales))
    table = spark.range(10).select(F.lit("x").alias("question"), columns.alias("columns"))
    assert "Exchange" not in route.route(table)._jdf.queryExecution().executedPlan().toString()


def test_routes_by_the_schema_of_each_dataset(spark):
    kind = "dataset_id string, columns array<struct<name:string,type:string>>"
    datasets = spark.createDataFrame(
        [("a", [("price", "numeric"), ("city", "categorical")]), ("b", [("price", "text")])], kind
    )
    asked = [("a", "price by city"), ("b", "price by city"), ("lost", "show 5 rows"), ("a", None)]
    questions = spark.createDataFrame(asked, "dataset_id string, question string")
    got = {(r["dataset_id"], r["question"]): r["template"]
           for r in route.route_by_dataset(questions, datasets).collect()}
    assert got == dict(zip(asked, ["grouped", None, None, None]))


def test_raw_rows_test_is_by_words(spark):
    df = spark.createDataFrame([("Show rows", True), ("showing rows", False), ("list the row.", True),
                                ("list rowing", False)], "q string, want boolean")
    assert df.filter(route.wants_raw_rows(F.col("q")) != F.col("want")).count() == 0


def test_answers(sales):
    columns = profile(sales.drop("row_number"))

    def ask_(q):
        got = route.answer(sales, columns, q, "row_number")
        return None if got is None else rows(got)

    assert len(ask_("show 4 rows")) == 4
    assert ask_("total revenue so far") == [(Decimal("140.00"),)]
    assert ask_("how many product") == [(2,)]
    assert ask_("how many things") == [(12,)]
    assert ask_("satisfaction on average") == [(4.0,)]
    assert ask_("revenue, split by region") == [("south", Decimal("80.00")), ("north", Decimal("60.00"))]
    assert ask_("top 1 order date with revenue") == [(dt.date(2024, 1, 1), Decimal("20.00"))]
    assert ask_("list all region revenue") == [("south", Decimal("80.00")), ("north", Decimal("60.00"))]
    assert ask_("revenue as it went over time")[0] == (dt.date(2024, 1, 1), Decimal("120.00"))
    assert ask_("which date has the highest revenue") == [(dt.date(2024, 1, 1), Decimal("120.00"))]
    assert ask_("hello") is None

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparkboard.functions import naming, values


def test_snake_case_header(spark):
    raw = ["CustomerID", "Customer ID", "PurchaseDate", "Total ($)", "SKU", "Sub.Category", "ID_x",
           "Größe (€)", "ÄnderungsDatum", "  Padded  ", "already_ok", "A1B"]
    assert naming.snake_case_columns(spark, raw) == [
        "customer_id", "customer_id_1", "purchase_date", "total", "s_k_u", "sub_category", "i_d_x",
        "größe", "änderungs_datum", "padded", "already_ok", "a1_b",
    ]


def test_repeated_names_stay_unique(spark):
    assert naming.unique_names(["a", "a", "a"]) == ["a", "a_1", "a_2"]
    # A name which is already taken is passed over.
    names = naming.snake_case_columns(spark, ["a b", "a_b", "a_b_1"])
    assert names == ["a_b", "a_b_1", "a_b_1_1"]


def test_blank_and_repeated_header_cells(spark):
    assert naming.snake_case_columns(spark, ["x", "x", None, ""]) == ["x", "x1", "unnamed_2", "unnamed_3"]


def test_rename_columns(spark):
    df = spark.createDataFrame([(1, 2)], "`Order ID` int, `orderDate` int")
    assert naming.rename_columns(df).columns == ["order_id", "order_date"]


def test_dataset_name(spark):
    names = spark.createDataFrame(
        [("My Sales.v2.CSV", "my_sales.v2"), ("plain", "plain"), ("a b.csv", "a_b")], "f string, want string"
    )
    got = names.withColumn("got", naming.dataset_name(F.col("f"))).filter("got <> want")
    assert got.count() == 0


@pytest.mark.parametrize("text,number", [
    ("12", 12.0), (" -1.5 ", -1.5), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0),
    ("1d", None), ("0x10", None), ("", None), ("1,000", None), ("abc", None), (None, None),
])
def test_parse_number(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(values.parse_number(F.col("t"))).head()[0] == number


@pytest.mark.parametrize("spelling,text,expected", [
    ("iso", "2024-02-01", dt.datetime(2024, 2, 1)),
    ("iso", "2024-2-1 10:30:05", dt.datetime(2024, 2, 1, 10, 30, 5)),
    ("iso", "1997", None),
    ("iso", "12:30", None),
    ("iso", "2024-02-30", None),
    ("m/d/y", "1/2/2024", dt.datetime(2024, 1, 2)),
    ("m/d/y", "13/02/2024", None),
    ("d/m/y", "13/02/2024 9:05", dt.datetime(2024, 2, 13, 9, 5)),
    ("d-m-y", "31-12-1999", dt.datetime(1999, 12, 31)),
    ("y/m/d", "2024/12/31", dt.datetime(2024, 12, 31)),
    ("d mon y", "5 Jan 2024", dt.datetime(2024, 1, 5)),
    ("month d, y", "January 5, 2024", dt.datetime(2024, 1, 5)),
])
def test_parse_date(spark, spelling, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(values.parse_date(F.col("t"), spelling)).head()[0] == expected


def test_typed_raises_or_gives_null(spark):
    df = spark.createDataFrame([("12.50",), ("x",)], "t string")
    got = [r[0] for r in df.select(values.typed(F.col("t"), "numeric", "null")).collect()]
    assert got == [12.5, None]
    with pytest.raises(Exception, match="not a number: 'x'"):
        df.select(values.typed(F.col("t"), "numeric")).collect()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(values.typed(F.col("t"), "datetime")).collect()


def test_typed_numbers_keep_their_digits(spark):
    texts = ["0.123456789012345", "1e-12", "1e30", " 7 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(values.typed(F.col("t"), "numeric")).collect()] == [float(t) for t in texts]


def test_times_with_an_offset_are_read_as_utc(spark):
    texts = ["2024-01-01T00:00:00+05:00", "2024-01-01T00:00:00Z", "2024-01-01 00:00:00", "2023-12-31T21:30:00.5-02:30"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(values.parse_date(F.col("t"), "iso")).collect()] == [
        dt.datetime(2023, 12, 31, 19), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 0, 500000)
    ]


def test_amounts_leave_out_nan_and_infinity(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (2.0,), (None,)], "x double")
    got = df.agg(*[f(df, "x", 2) for f in (values.total_of, values.average_of, values.smallest_of, values.largest_of)]).head()
    assert [float(v) for v in got] == [3.0, 1.5, 1.0, 2.0]


def test_large_amounts_are_summed_exactly(spark):
    df = spark.range(3000).select(F.lit(-9.9e15).alias("x"), (F.lit(9.9e15) + F.col("id")).alias("y"))
    assert df.agg(values.total_of(df, "x", 2)).head()[0] == Decimal("-9.9e15") * 3000
    many = spark.range(20_000_000).select(F.lit(9.9e15).alias("x"))
    assert many.agg(values.total_of(many, "x", 2)).head()[0] == Decimal("9.9e15") * 20_000_000


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, None), (None, 3)], "x double, y int")
    assert [tuple(r) for r in values.nan_to_null(df).collect()] == [(None, 1), (2.0, None), (None, 3)]


def test_measure_of_text_boolean_and_date(spark):
    df = spark.createDataFrame([("1.10", True, dt.date(2024, 1, 1))], "t string, b boolean, d date")
    row = df.select(values.measure(df, "t").alias("t"), values.measure(df, "b").alias("b")).head()
    assert row["t"] == 1.1 and row["b"] == 1
    with pytest.raises(TypeError):
        values.measure(df, "d")


def test_exact_sums_equal_sums_of_decimals(spark):
    odd = [0.005, -0.005, 1.005, 2.675, 0.125, -0.125, 1e-9, -1e-9, 0.0, 99999999999.99, -12345678.915,
           1e15 + 0.25, -9007199254740993.0, 3.3333333, None]
    df = spark.range(4000).select(
        (F.col("id") % 3).alias("g"),
        F.when(F.col("id") < 3000, F.round(F.rand(7) * 2e6 - 1e6, 2)).otherwise(F.rand(8) * 10 - 5).alias("v"),
    ).unionAll(spark.createDataFrame([(i % 3, v) for i, v in enumerate(odd)], "g long, v double"))
    got = df.groupBy("g").agg(
        values.total_of(df, "v", 2).alias("t"), F.sum(F.col("v").cast("decimal(18,2)")).alias("want_t"),
        values.average_of(df, "v", 2).alias("a"), F.avg(F.col("v").cast("decimal(18,2)")).alias("want_a"),
        values.smallest_of(df, "v", 2).alias("s"), F.min(F.col("v").cast("decimal(18,2)")).alias("want_s"),
        values.largest_of(df, "v", 2).alias("l"), F.max(F.col("v").cast("decimal(18,2)")).alias("want_l"),
    ).collect()
    for r in got:
        assert (r["t"], r["a"], r["s"], r["l"]) == (r["want_t"], r["want_a"], r["want_s"], r["want_l"])
    nothing = df.filter("v is null")
    row = nothing.agg(values.total_of(nothing, "v", 2), values.average_of(nothing, "v", 2)).head()
    assert tuple(row) == (None, None)


def test_sums_of_integers_and_decimals_keep_their_exactness(spark):
    df = spark.createDataFrame([(1, Decimal("0.10"), 1.5), (2, Decimal("0.20"), 1.5)], "i int, d decimal(9,2), f float")
    row = df.agg(*[values.total_of(df, c, 2).alias(c) for c in "idf"]).head()
    assert tuple(row) == (Decimal("3.00"), Decimal("0.30"), Decimal("3.00"))

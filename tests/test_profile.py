import pytest
from pyspark.sql import functions as F

from sparkboard.operators.profile import cast_by_profile, distinct_ratio, profile, type_lookup


def types(df, **options):
    return {r["name"]: (r["type"], r["target"], r["spelling"]) for r in profile(df, **options).collect()}


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v string")


@pytest.mark.parametrize("values,expected", [
    (["1", "-2", " 3 "], ("numeric", "bigint", None)),
    (["1.50", "22.5", None], ("numeric", "decimal(4,2)", None)),
    (["1e5", "2"], ("numeric", "double", None)),
    (["1" * 30, "2"], ("numeric", "decimal(30,0)", None)),
    (["1" * 45, "2"], ("numeric", "double", None)),
    (["True", "false", None], ("numeric", "boolean", None)),
    (["1997", "1998"], ("numeric", "bigint", None)),
    (["2024-01-05", "2024-1-6 10:00:00"], ("datetime", "timestamp_ntz", "iso")),
    (["01/02/2024", "03/04/2024"], ("datetime", "timestamp_ntz", "m/d/y")),
    (["01/02/2024", "13/04/2024"], ("datetime", "timestamp_ntz", "d/m/y")),
    (["5 Jan 2024", "17 Feb 2024"], ("datetime", "timestamp_ntz", "d mon y")),
    (["May 5, 2024", "Jun 7, 2024"], ("datetime", "timestamp_ntz", "mon d, y")),
    (["12:30", "12:31"], ("text", "string", None)),
    (["2024-01-05", "01/02/2024"], ("text", "string", None)),
    (["a", "b", "a", "b"], ("text", "string", None)),  # exactly half distinct
    (["a", "b", "a", "b", "a"], ("categorical", "string", None)),
    ([None, None], ("text", "string", None)),
    (["1"] * 100 + ["x"], ("categorical", "string", None)),
    (["x" * 100, "x" * 100, "x" * 100], ("categorical", "string", None)),
])
def test_type_of_text_values(spark, values, expected):
    assert types(column(spark, values))["v"] == expected


def test_empty_column_of_a_file_counts_as_numbers(spark):
    assert types(column(spark, [None]), all_null="numeric")["v"] == ("numeric", "double", None)


def test_sample_sees_only_the_first_values(spark):
    df = spark.createDataFrame(
        [(i, "7" if i <= 100 else "x") for i in range(1, 301)] + [(0, None)], "n long, v string"
    )
    assert types(df)["v"][0] == "categorical"
    assert types(df, sample_rows=100, order_by="n")["v"][0] == "numeric"
    assert types(df, sample_rows=101, order_by="n")["v"][0] == "categorical"
    with pytest.raises(ValueError):
        profile(df, sample_rows=100)


def test_long_texts_are_numbers_and_dates_too(spark):
    df = spark.createDataFrame([(" " * 70 + "12", "0" * 66 + "7", "2024-01-02T00:00:00." + "0" * 60)], "a string, b string, c string")
    assert {n: t[0] for n, t in types(df).items()} == {"a": "numeric", "b": "numeric", "c": "datetime"}


def test_a_cast_does_not_lose_values_in_silence(spark):
    df = spark.createDataFrame([(i, "2024-01-01" if i < 5 else "soon") for i in range(8)], "n long, d string")
    found = profile(df, sample_rows=5, order_by="n")
    with pytest.raises(Exception, match="not a date of its column: 'soon'"):
        cast_by_profile(df, found).collect()
    assert cast_by_profile(df, found, on_error="null").where("d is null").count() == 3


def test_typed_columns_follow_the_schema(spark):
    df = spark.sql("select 1 a, 1.5d b, true c, date'2024-01-01' d, timestamp'2024-01-01' e, array(1) f")
    got = {n: t[0] for n, t in types(df).items()}
    assert got == {"a": "numeric", "b": "numeric", "c": "numeric", "d": "datetime", "e": "datetime", "f": "text"}


def test_counts_and_odd_names(spark):
    df = spark.createDataFrame([("x", None), ("x", "z"), (None, "y")], "`a.b` string, `c d` string")
    got = {r["name"]: (r["row_count"], r["non_null"], r["distinct_count"]) for r in profile(df).collect()}
    assert got == {"a.b": (3, 2, 1), "c d": (3, 2, 2)}


def test_no_rows_and_no_text(spark):
    empty = spark.createDataFrame([], "a string, b int")
    assert [(r["type"], r["row_count"]) for r in profile(empty).collect()] == [("text", 0), ("numeric", 0)]
    assert profile(spark.range(7)).head()["row_count"] == 7


def test_approximate_counts(spark):
    df = spark.range(1000).select(F.concat(F.lit("v"), F.col("id") % 10).alias("v"))
    assert profile(df, approximate=True).head()["type"] == "categorical"


def test_cast_by_profile_tags_columns(spark):
    df = spark.createDataFrame([("1", "2024-01-01", "x"), ("2", "2024-01-02", "x")], "a string, b string, c string")
    typed = cast_by_profile(df, profile(df))
    assert [f.dataType.simpleString() for f in typed.schema] == ["bigint", "timestamp_ntz", "string"]
    assert [f.metadata["logical_type"] for f in typed.schema] == ["numeric", "datetime", "text"]


def test_ratio_and_lookup(spark):
    df = column(spark, ["a", "a", "b", None])
    assert tuple(distinct_ratio(df, "v").head()) == (2, 3, 2 / 3)
    assert distinct_ratio(column(spark, [None]), "v").head()["distinct_ratio"] is None
    found = type_lookup(spark.createDataFrame([("v",), ("w",)], "name string"), profile(df))
    assert {r["name"]: r["type"] for r in found.collect()} == {"v": "text", "w": "unknown"}

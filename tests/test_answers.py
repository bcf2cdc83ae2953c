"""Questions answered in one run of their plan."""

from pyspark.sql import functions as F

from sparkboard.operators import route
from sparkboard.operators.profile import profile


def test_an_answer_reads_its_dataset_once(spark):
    plain = spark.range(400).repartition(4).select(
        F.col("id"), F.concat(F.lit("c"), F.col("id") % 5).alias("city"), (F.col("id") % 37).cast("double").alias("sales")
    )
    columns = profile(plain)
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def tracked(value):
        read.add(1)
        return value

    df = plain.withColumn("sales", tracked("sales"))
    for question, shape, n in (("sales by city", "chart", 5), ("total sales", "kpi", 1), ("show me 7 rows", "table", 7), ("top 3 sales", "table", 3)):
        before = read.value
        a = route.ask_dataset(df, columns, question, "id")
        assert (a.status, a.shape, a.n_rows) == ("answered", shape, n)
        found = a.result.collect()
        assert len(found) == n
        assert read.value - before <= 400
        if shape == "chart":  # the largest first
            assert [r["sales"] for r in found] == sorted((r["sales"] for r in found), reverse=True)
    assert route.ask_dataset(df, columns, "why?", "id").status == "unknown"


def test_failures_and_empty_results_are_told(spark):
    df = spark.createDataFrame([], "id long, city string, sales double")
    columns = profile(spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "a", 2.0)], "id long, city string, sales double"))
    empty = route.ask_dataset(df, columns, "sales by city", "id")
    assert (empty.status, empty.shape, empty.n_rows) == ("answered", "empty", 0)
    failed = route.ask_dataset(df.drop("sales"), columns, "total sales", "id")
    assert failed.status == "failed" and failed.reason
    text = spark.createDataFrame([(1, "a", "soon")], "id long, city string, sales string")
    assert route.ask_dataset(text, columns, "total sales", "id").status == "failed"

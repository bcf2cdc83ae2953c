"""Approximate box plots against the exact ones."""

import pytest
from pyspark.sql import functions as F

from sparkboard.operators import charts
from sparkboard.operators.sketches import approximate_boxes, box_sketches, merged_sketches, rank_errors


def values(spark):
    return spark.range(60_000).repartition(6).select(
        (F.col("id") % 3).cast("string").alias("a.b"), (F.col("id") % 7).alias("day"),
        F.when(F.col("id") % 11 == 0, None).when(F.col("id") == 3, float("nan")).when(F.col("id") == 4, float("inf"))
        .otherwise(F.exp(F.randn(5))).alias("x"),
    )


def test_merged_parts_are_within_the_stated_error(spark):
    df = values(spark).cache()
    whole = merged_sketches(box_sketches(df, "x", ["a.b", "day"]), ["a.b"])
    got = {r["a.b"]: r for r in approximate_boxes(whole, ["a.b"]).collect()}
    finite = df.where("x < double('inf')")
    want = {r["a.b"]: r for r in charts.box(finite, "x", ["a.b"]).collect()}
    assert got.keys() == want.keys() == {"0", "1", "2"}
    for key, exact in want.items():
        mine = got[key]
        assert (mine["n"], mine["min"], mine["max"]) == (exact["n"], exact["min"], exact["max"])
        assert mine["low_whisker"] == exact["low_whisker"]  # no fence below
        assert mine["high_whisker"] == pytest.approx(exact["high_whisker"], rel=0.1)
        assert abs(mine["outliers"] - exact["outliers"]) <= 0.01 * exact["n"]
    errors = [r["error"] for r in rank_errors(df, "x", approximate_boxes(whole, ["a.b"]), ["a.b"]).collect()]
    assert len(errors) == 3 and max(errors) < 0.01
    df.unpersist()


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", None), (None, 5.0)], "g string, x double")
    boxes = {r["g"]: r for r in approximate_boxes(box_sketches(df, "x", ["g"]), ["g"]).collect()}
    assert set(boxes) == {"a", None}
    assert boxes["a"]["median"] == 2.0 and boxes["a"]["outliers"] == 0 and boxes[None]["low_whisker"] == 5.0
    assert [r["error"] for r in rank_errors(df, "x", approximate_boxes(box_sketches(df, "x", ["g"]), ["g"]), ["g"]).collect()] == [0.0, 0.0]
    assert approximate_boxes(box_sketches(df.limit(0), "x")).collect() == []
    assert approximate_boxes(merged_sketches(box_sketches(df.limit(0), "x"))).collect() == []
    far = spark.createDataFrame([(float(i),) for i in range(100)] + [(10_000.0,)], "x double")
    assert approximate_boxes(box_sketches(far, "x")).head()["outliers"] == 1

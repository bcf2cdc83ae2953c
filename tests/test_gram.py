"""Correlations of many columns against those of pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkboard.operators import charts
from sparkboard.operators.gram import wide_correlations


def cells(df):
    return {(r["x"], r["y"]): r["correlation"] for r in df.collect()}


def by_pairs(df):
    """Pair by pair, from the rows in which both have a value."""
    rows, found = [r.asDict() for r in df.collect()], {}
    for a in df.columns:
        for b in df.columns:
            x, y = np.array([(r[a], r[b]) for r in rows if r[a] is not None and r[b] is not None], float).reshape(-1, 2).T
            if np.isnan(x).any() or np.isnan(y).any():
                found[a, b] = math.nan
            elif len(x) < 2 or x.min() == x.max() or y.min() == y.max():
                found[a, b] = None
            else:
                found[a, b] = float(np.corrcoef(x, y)[0, 1])
    return found


def same(got, want):
    assert got.keys() == want.keys()
    for pair, value in want.items():
        mine = got[pair]
        if value is None or math.isnan(value):
            assert mine is None if value is None else math.isnan(mine), pair
        else:
            assert mine == pytest.approx(value, abs=1e-9), pair


def test_nulls_are_left_out_by_pairs(spark):
    df = spark.range(3000).repartition(7).select(
        F.when(F.col("id") % 3 > 0, F.sin("id")).alias("a"), F.when(F.col("id") % 5 > 1, F.sin("id") + F.rand(3)).alias("b.x"),
        (F.col("id") * 1e6 + 1e12).alias("c"), F.lit(0.1).alias("constant"), F.lit(None).cast("double").alias("nothing"),
        F.when(F.col("id") == 5, 1.0).alias("once"), F.when(F.col("id") == 9, F.lit(float("nan"))).otherwise(F.col("id") / 1.0).alias("nan"),
        F.when(F.col("id") % 3 == 0, F.cos("id")).alias("never_with_a"),
    )
    want = by_pairs(df)
    same(cells(wide_correlations(df, block=3)), want)
    # The plan of aggregates, for few columns.
    few = [c for c in df.columns if c != "never_with_a"][:charts.CORRELATED_AT_ONCE]
    same(cells(charts.correlations(df.select(*[F.col(f"`{c}`") for c in few]), few)), {p: v for p, v in want.items() if set(p) <= set(few)})


def test_no_rows_and_repeated_rows(spark):
    none = spark.createDataFrame([], "a double, b double")
    assert cells(wide_correlations(none)) in ({}, dict.fromkeys([(x, y) for x in "ab" for y in "ab"]))
    df = spark.createDataFrame([(1.0, 2.0)] * 5 + [(2.0, 1.0)] * 5, "a double, b double")
    same(cells(wide_correlations(df)), {("a", "a"): 1.0, ("b", "b"): 1.0, ("a", "b"): -1.0, ("b", "a"): -1.0})


def test_500_columns_in_one_pass(spark):
    width, rows = 500, 4000
    values = np.random.default_rng(4).normal(size=(rows, width)).cumsum(axis=1)
    df = spark.createDataFrame([(v.tolist(),) for v in values], "v array<double>").repartition(8)
    df = df.select(*[F.col("v")[i].alias(f"c{i}") for i in range(width)])
    found = charts.correlations(df, df.columns)
    got = cells(found)
    want = np.corrcoef(values.T)
    assert len(got) == width * width
    assert max(abs(got[f"c{i}", f"c{j}"] - want[i, j]) for i in range(width) for j in range(width)) < 1e-9
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + found._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1

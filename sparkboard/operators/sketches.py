"""Box plots from quantile sketches: one pass, kept per part of a table, merged without reading the rows again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparkboard.functions.values import measure, quoted

# A sketch of this size errs by less than 0.4 % of the rows in a rank (99 % of the time), at 12 kB or less.
SKETCH_SIZE = 800
# The shares of the rows at which a sketch is asked for values.
STEPS = 1000


def box_sketches(df: DataFrame, column: str, by: Sequence[str] = (), size: int = SKETCH_SIZE) -> DataFrame:
    """(by, n, min, max, sketch) per group: a few kilobytes, however many rows there are.

    Nulls, NaN and infinities are left out; a group without a number has no row.
    """
    value = measure(df, column).cast("double")
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    rows = df.select(*[quoted(b).alias(b) for b in by], finite.alias("__value")).where("__value IS NOT NULL")
    return rows.groupBy(*map(quoted, by)).agg(
        F.count(F.lit(1)).alias("n"), F.min("__value").alias("min"), F.max("__value").alias("max"),
        F.kll_sketch_agg_double("__value", F.lit(size)).alias("sketch"),
    ).where("n > 0")


def merged_sketches(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of whole groups from those of parts: of days, of appended files, of finer groups."""
    return parts.groupBy(*map(quoted, by)).agg(
        F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    ).where("n > 0")


def approximate_boxes(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Columns as of `charts.box`, from sketches: `n`, `min` and `max` are exact.

    Quartiles are values of the column whose rank errs as the sketch does. Whiskers are the outermost of
    1,001 evenly spaced quantiles within the fences, the extreme value itself where no fence is inside;
    `outliers` errs by the sketch's error and a step of this grid.
    """
    grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]))
    at = lambda share: F.get("__grid", int(share * STEPS))
    boxes = sketches.withColumn("__grid", grid).withColumns({"q1": at(0.25), "median": at(0.5), "q3": at(0.75)})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    boxes = boxes.withColumns({"__low": F.col("q1") - reach, "__high": F.col("q3") + reach})
    low_out, high_out = F.col("min") < F.col("__low"), F.col("max") > F.col("__high")
    inside = F.filter("__grid", lambda v: v.between(F.col("__low"), F.col("__high")))
    outside = _rows(F.size(F.filter("__grid", lambda v: v < F.col("__low"))), low_out) + _rows(
        F.size(F.filter("__grid", lambda v: v > F.col("__high"))), high_out
    )
    return boxes.select(
        *map(quoted, by), "n", "min", F.when(low_out, F.array_min(inside)).otherwise(F.col("min")).alias("low_whisker"),
        "q1", "median", "q3", F.when(high_out, F.array_max(inside)).otherwise(F.col("max")).alias("high_whisker"), "max",
        outside.cast("bigint").alias("outliers"),
    )


def _rows(steps: Column, any_beyond: Column) -> Column:
    rows = F.round(steps * F.col("n") / F.lit(STEPS + 1.0))
    return F.when(any_beyond, F.greatest(rows, F.lit(1.0))).otherwise(0.0)


def rank_errors(df: DataFrame, column: str, boxes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, error): how far a group's worst quartile is from its rank, as a share of the rows, counted exactly."""
    value = measure(df, column).cast("double")
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.select(*[quoted(b).alias(k) for b, k in zip(by, keys, strict=True)], finite.alias("__value")).where("__value IS NOT NULL")
    quartiles = boxes.select(*[quoted(b).alias(f"{k}_") for b, k in zip(by, keys, strict=True)], "q1", "median", "q3")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    wanted = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    counts = rows.join(quartiles, same).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("__value") < F.col(q)).alias(f"{q}_below") for q in wanted],
        *[F.count_if(F.col("__value") <= F.col(q)).alias(f"{q}_upto") for q in wanted],
    )
    n = F.col("n")
    errors = [
        F.greatest(F.lit(0.0), F.col(f"{q}_below") / n - p, p - F.col(f"{q}_upto") / n) for q, p in wanted.items()
    ]
    return counts.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], F.greatest(*errors).alias("error"))

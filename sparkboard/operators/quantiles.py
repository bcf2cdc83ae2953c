"""Exact quantiles per group by narrowing down ranges of values.

The rows themselves never move. A pass sketches the values of every wide range, brackets each wanted rank
by two values of the sketch, and then counts exactly what lies below, between and above, and at the
brackets' ends; the pieces which hold a wanted rank become the ranges of the next pass. A sketch errs by
rank, not by value, so that a pass leaves about three thousandths of a range's rows, however the values
are spread; equal values at a bracket's end are settled at once. Once a range holds few enough rows, its
values are ranked. The tables between the passes have a few rows per group, so Spark broadcasts
them when their written size allows it and joins by shuffle when there are too many groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkboard.functions.values import quoted
from sparkboard.sources.scratch import discard, materialize

# A sketch tells the values at these shares of a range, each to within 1 / ACCURACY of its rows.
GRID, ACCURACY = 1000, 10_000
# Ranges with up to this many rows are ranked in one task.
RANKED_AT_ONCE = 100_000
METHODS = ("linear", "midpoint")


def group_values(df: DataFrame, value: Column, by: Sequence[Column]) -> DataFrame:
    """The group columns as `g0..` and `value` as a double; nulls and NaN are left out."""
    groups = [c.alias(f"g{i}") for i, c in enumerate(by)]
    rows = df.select(*groups, value.cast("double").alias("value"))
    return rows.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def group_columns(values: DataFrame) -> list[str]:
    return [c for c in values.columns if c != "value"]


def attach(
    rows: DataFrame, per_group: DataFrame, by: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Add the columns of a per-group table to the rows of the group (null is a group too).

    Without group columns the table has at most one row, whose values are constants of the query.
    """
    own = [quoted(c) for c in rows.columns]
    extra = [c for c in per_group.columns if c not in rows.columns]
    added = [quoted(c) for c in extra]
    if not by:
        only = per_group.select(F.struct(*added).alias("s")).scalar()
        constants = [F.col("__s")[c].alias(c) for c in extra]
        return rows.withColumn("__s", only).select(*own, *constants)
    keyed = per_group.select(*[quoted(b).alias(f"__{b}") for b in by], *added)
    same = reduce(lambda a, b: a & b, (quoted(b).eqNullSafe(quoted(f"__{b}")) for b in by))
    return rows.join(keyed, same, how).select(*own, *added)


def quantiles(
    values: DataFrame,
    probabilities: Sequence[float],
    method: str = "linear",
    ranked_at_once: int = RANKED_AT_ONCE,
) -> DataFrame:
    """Quantiles of a table made by `group_values`: group columns, `rows`, `lo`, `hi`, `q0..`.

    "linear" interpolates at position p*(n-1), as the SQL function PERCENTILE_CONT does;
    "midpoint" at p*n - 1/2, as plotting libraries do for box plots.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}, not {method!r}")
    by = group_columns(values)
    stats = materialize(
        values.groupBy(*by).agg(
            F.count(F.lit(1)).alias("rows"), F.min("value").alias("lo"), F.max("value").alias("hi")
        ).filter("rows > 0"),
        "quantile-groups",
    )
    places = [_position(p, method) for p in probabilities]
    ranks = F.array_distinct(F.array(*[f(at).cast("bigint") for at in places for f in (F.floor, F.ceil)]))
    ranges = stats.select(
        *by, "lo", "hi", F.col("rows").alias("n"), F.lit(0).cast("bigint").alias("before"),
        ranks.alias("ranks"),
    )
    is_wide = (F.col("n") > ranked_at_once) & (F.col("lo") < F.col("hi"))
    while not ranges.filter(is_wide).isEmpty():
        narrowed = _narrow(values, ranges.filter(is_wide), by)
        after = materialize(ranges.filter(~is_wide).unionByName(narrowed), "quantile-ranges")
        discard(ranges)
        ranges = after

    found = _rank(values, ranges, by).groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at")
    )
    results = []
    for i, at in enumerate(places):
        low = F.col("at")[F.floor(at).cast("bigint")]
        high = F.col("at")[F.ceil(at).cast("bigint")]
        results.append((low + (high - low) * (at - F.floor(at))).alias(f"q{i}"))
    return attach(stats, found, by).select(*by, "rows", "lo", "hi", *results)


def _position(p: float, method: str) -> Column:
    """Where a quantile lies among the ranks 0..rows-1."""
    last = (F.col("rows") - 1).cast("double")
    if method == "linear":
        return F.lit(float(p)) * last
    return F.least(F.greatest(F.lit(float(p)) * F.col("rows") - 0.5, F.lit(0.0)), last)


def _inside(values: DataFrame, ranges: DataFrame, by: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """The rows which fall into a range of their group, with its limits and its columns `more`.

    The ranges of a group do not overlap. There are at most two per quantile, so that those of the
    whole table fit into a constant.
    """
    if not by:
        limits = ranges.agg(F.collect_list(F.struct("lo", "hi", *more))).scalar()
        own = F.filter("__r", lambda r: F.col("value").between(r["lo"], r["hi"]))
        return (
            values.withColumn("__r", limits)
            .withColumn("__own", F.get(own, 0))
            .filter(F.col("__own").isNotNull())
            .select("value", "__own.lo", "__own.hi", *[f"__own.{m}" for m in more])
        )
    within = attach(values, ranges.select(*by, "lo", "hi", *more), by)
    return within.filter(F.col("value").between(F.col("lo"), F.col("hi")))


def _narrow(values: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Cut every range at the values around its wanted ranks and keep the pieces which hold one."""
    shares = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    sketched = _inside(values, ranges, by).groupBy(*by, "lo").agg(
        F.percentile_approx("value", shares, F.lit(ACCURACY)).alias("grid")
    )
    at = lambda r: F.floor((r - F.col("before")) * GRID / F.col("n")).cast("int")
    around = F.transform("ranks", lambda r: F.array(
        F.get("grid", F.greatest(at(r) - 1, F.lit(0))), F.get("grid", F.least(at(r) + 2, F.lit(GRID)))
    ))
    cut = attach(ranges, sketched, [*by, "lo"]).withColumn("cuts", F.array_sort(F.array_distinct(F.flatten(around))))
    cut = materialize(cut.drop("grid"), "quantile-cuts")
    # Odd pieces hold the values equal to a cut, even ones those between cuts.
    below = F.size(F.filter("cuts", lambda c: c < F.col("value")))
    piece = 2 * below + F.array_contains("cuts", F.col("value")).cast("int")
    pieces = _inside(values, cut, by, ("cuts",)).groupBy(*by, "lo", piece.alias("piece")).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("first"), F.max("value").alias("last")
    )
    # A few rows per range reach this window.
    upto = Window.partitionBy(*by, "lo").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    ends = pieces.withColumn("end", F.sum("n").over(upto))
    return _with_hits(ends, ranges, by).select(
        *by, F.col("first").alias("lo"), F.col("last").alias("hi"), "n",
        F.col("start").alias("before"), F.col("hits").alias("ranks"),
    )


def _with_hits(ends: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Ranks covered by each piece of a range (`n` rows, `end` rows up to it), as `start` and `hits`.

    Pieces which hold no wanted rank are left out.
    """
    known = attach(ends, ranges.select(*by, "lo", "before", "ranks"), [*by, "lo"])
    placed = known.withColumn("stop", F.col("before") + F.col("end")).withColumn(
        "start", F.col("stop") - F.col("n")
    )
    hits = F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("stop")))
    return placed.withColumn("hits", hits).filter(F.size("hits") > 0)


def _rank(values: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """The value at every wanted rank: (group, rank, value)."""
    single = F.col("lo") == F.col("hi")
    settled = ranges.filter(single).select(*by, F.explode("ranks").alias("rank"), F.col("lo").alias("value"))
    open_ranges = ranges.filter(~single)
    counts = _inside(values, open_ranges, by).groupBy(*by, "lo", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    upto = Window.partitionBy(*by, "lo").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ends = counts.withColumn("end", F.sum("n").over(upto))
    ranked = _with_hits(ends, open_ranges, by).select(*by, F.explode("hits").alias("rank"), "value")
    return settled.unionByName(ranked)

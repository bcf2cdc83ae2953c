"""Correlations of wide tables: one pass which adds up the products of all pairs of columns, block by block.

A task multiplies its batches of rows as matrices and holds, for every pair of columns, the moments of the
rows in which both have a value: the count, two means, two sums of squared departures and one of products.
Moments of parts merge without loss of digits, so that each task sends one row per block of pairs, and the
rows of a block meet in two steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

# Columns of a block; a block's row is 7 matrices of this size squared (0.2 MB).
BLOCK = 64
# Moments of a pair (x, y); `odd` counts rows in which one of the two is NaN or infinite.
MOMENTS = ("n", "mean_x", "mean_y", "square_x", "square_y", "product", "odd")


def wide_correlations(numbers: DataFrame, block: int = BLOCK) -> DataFrame:
    """(x, y, correlation) of every ordered pair of the columns, all of them doubles.

    A pair is looked at in the rows in which both have a value. It is null for fewer than two such rows and
    where one of the columns is constant in them, NaN where one is NaN or infinite in one of them.
    """
    names = numbers.columns
    width = len(names)
    edges = [(at, min(at + block, width)) for at in range(0, width, block)]
    pairs = [(a, b) for a in range(len(edges)) for b in range(a, len(edges))]
    schema = "a int, b int, part int, " + ", ".join(f"{m} binary" for m in MOMENTS)
    columns = ["a", "b", "part", *MOMENTS]
    groups = max(1, int(np.ceil(np.sqrt(numbers.sparkSession.sparkContext.defaultParallelism))))

    # Inner functions travel with the plan: no worker needs this package.
    def merged(p: dict | None, q: dict) -> dict:
        if p is None:
            return q
        n = p["n"] + q["n"]
        some = np.maximum(n, 1)
        dx, dy = q["mean_x"] - p["mean_x"], q["mean_y"] - p["mean_y"]
        weight = p["n"] * q["n"] / some
        return {
            "n": n, "mean_x": p["mean_x"] + dx * q["n"] / some, "mean_y": p["mean_y"] + dy * q["n"] / some,
            "square_x": p["square_x"] + q["square_x"] + dx * dx * weight,
            "square_y": p["square_y"] + q["square_y"] + dy * dy * weight,
            "product": p["product"] + q["product"] + dx * dy * weight, "odd": p["odd"] + q["odd"],
        }

    def moments(batch: pa.RecordBatch) -> dict:
        there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64)
        finite = there & np.isfinite(x)
        x = np.where(finite, x, 0.0)
        # Around a value of the column, so that a constant one has no spread at all, and near its mean.
        low, high = np.where(finite, x, np.inf).min(axis=0), np.where(finite, x, -np.inf).max(axis=0)
        middle = np.where(low == high, low, x.sum(axis=0) / np.maximum(finite.sum(axis=0), 1))
        x = np.where(finite, x - middle, 0.0)
        here, strange = finite.astype(np.float64), (there & ~finite).astype(np.float64)
        n, sums, squares, products = here.T @ here, x.T @ here, (x * x).T @ here, x.T @ x
        some = np.maximum(n, 1)
        spread = np.maximum(squares - sums * sums / some, 0.0)
        mean = np.where(n > 0, middle[:, None] + sums / some, 0.0)
        any_strange = strange.any()
        odd = strange.T @ there + there.T @ strange if any_strange else np.zeros_like(n)
        return {"n": n, "mean_x": mean, "mean_y": mean.T, "square_x": spread, "square_y": spread.T, "product": products - sums * sums.T / some, "odd": odd}

    def row(a: int, b: int, part: int, found: dict) -> pa.RecordBatch:
        cells = [pa.array([np.ascontiguousarray(found[m], np.float64).tobytes()], pa.binary()) for m in MOMENTS]
        return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (a, b, part)), *cells], columns)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = merged(total, moments(batch))
        if total is not None:
            part = TaskContext.get().partitionId() % groups
            for a, b in pairs:
                rows, others = slice(*edges[a]), slice(*edges[b])
                yield row(a, b, part, {m: total[m][rows, others] for m in MOMENTS})

    def together(batches: Iterator[pa.RecordBatch], a: int, b: int) -> dict:
        shape = (edges[a][1] - edges[a][0], edges[b][1] - edges[b][0])
        total = None
        for batch in batches:
            for k in range(batch.num_rows):
                total = merged(total, {m: np.frombuffer(batch.column(m)[k].as_py()).reshape(shape) for m in MOMENTS})
        return total

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, part = (k.as_py() for k in key)
        yield row(a, b, part, together(batches, a, b))

    def finish(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = (k.as_py() for k in key)
        t = together(batches, a, b)
        known = (t["n"] > 1) & (t["square_x"] > 0) & (t["square_y"] > 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            value = t["product"] / (np.sqrt(t["square_x"]) * np.sqrt(t["square_y"]))
        value = np.where(t["odd"] > 0, np.nan, np.clip(value, -1.0, 1.0))
        known |= t["odd"] > 0
        i, j = np.meshgrid(np.arange(*edges[a]), np.arange(*edges[b]), indexing="ij")
        i, j, value, known = i.ravel(), j.ravel(), value.ravel(), known.ravel()
        if a != b:
            i, j, value, known = np.r_[i, j], np.r_[j, i], np.r_[value, value], np.r_[known, known]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(value, pa.float64(), mask=~known)], ["i", "j", "correlation"]
        )

    plain = numbers.toDF(*[f"c{i}" for i in range(width)])
    sums = plain.mapInArrow(multiply, schema).groupBy("a", "b", "part").applyInArrow(add, schema)
    cells = sums.groupBy("a", "b").applyInArrow(finish, "i int, j int, correlation double")
    listed = F.array(*[F.lit(n) for n in names])
    return cells.select(F.get(listed, "i").alias("x"), F.get(listed, "j").alias("y"), "correlation")

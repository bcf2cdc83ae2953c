"""Similarity joins inside shards, without one task per hot shard and without rows per pair.

A router deals every item to the shard it lives in and, as a visitor, to the shards it may have a
partner in. `paired` compares the items of each shard in tiles of bounded size; a tile returns what
its pairs add up to (links per item, a spanning forest), never the pairs. `components` joins the
forests of all tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sparkboard.llm.shared import dropped, saved

TILE = 8192
LIVES, VISITS = 0, 1


def in_tiles(routed: DataFrame, tile: int = TILE) -> DataFrame:
    """Rows (shard, role, item, ...) copied to the tiles they take part in: adds `i`, `j` and `side`.

    A shard of n residents and v visitors becomes ceil(n / tile) x ceil((n + v) / tile) tiles, so a
    shard which holds a third of all items is many tasks. `side` 0: left only, 1: right only, 2: both.
    Residents are the left side; residents and visitors the right one.
    """
    sizes = routed.groupBy("shard").agg(
        F.ceil(F.sum((F.col("role") == LIVES).cast("long")) / tile).alias("_left"),
        F.ceil(F.count(F.lit(1)) / tile).alias("_right"),
    )
    # A shard nobody lives in has no pairs.
    rows = routed.join(sizes.where("_left > 0"), "shard")
    h = F.xxhash64("item", F.lit(17))
    single = (F.col("_left") == 1) & (F.col("_right") == 1)
    lives = F.col("role") == LIVES
    i, j = F.pmod(h, F.col("_left")).cast("int"), F.pmod(h, F.col("_right")).cast("int")

    def at(x, y, side):
        return F.struct(x.cast("int").alias("i"), y.cast("int").alias("j"), F.lit(side).alias("side"))

    every = lambda n: F.sequence(F.lit(0), n.cast("int") - 1)
    as_left = F.transform(every(F.col("_right")), lambda y: at(i, y, 0))
    as_right = F.transform(every(F.col("_left")), lambda x: at(x, j, 1))
    places = (
        F.when(single & lives, F.array(at(F.lit(0), F.lit(0), 2)))
        .when(lives, F.concat(as_left, as_right))
        .otherwise(as_right)
    )
    return (
        rows.withColumn("_place", F.explode(places))
        .select("*", "_place.i", "_place.j", "_place.side")
        .drop("_left", "_right", "_place", "role")
    )


def paired(tiles: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """`compare(left, right)` for each tile."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        side = rows["side"].to_numpy()
        return compare(rows[side != 1], rows[side != 0])

    return tiles.groupBy("shard", "i", "j").applyInPandas(one, schema)


def blocks(n: int, m: int, rows: int = 1024, columns: int = 2048) -> Iterator[tuple[slice, slice]]:
    for a in range(0, n, rows):
        for b in range(0, m, columns):
            yield slice(a, min(a + rows, n)), slice(b, min(b + columns, m))


class Forest:
    """Labels of the items of one tile, joined pair by pair."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.label[u], self.label[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            low = np.minimum(a, b)
            np.minimum.at(self.label, a, low)
            np.minimum.at(self.label, b, low)
            while not np.array_equal(deeper := self.label[self.label], self.label):
                self.label = deeper


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component): every node of the edges (a, b) with the smallest node it is connected to.

    Alternates large and small stars: each round every node links its larger neighbours, then its
    smaller ones, to the smallest it knows. The rounds grow with the logarithm of the longest chain.
    Hot nodes cost one partial row per task in the minimum, and the join back is split by AQE.
    """
    now = saved(_loose(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), name)
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = saved(_loose(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = saved(_loose(small), name)
        dropped(now, large)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _loose(pairs: DataFrame) -> DataFrame:
    """Distinct pairs of different nodes, the larger first."""
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(pairs: DataFrame) -> tuple:
    """Changes when the set of pairs does."""
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())

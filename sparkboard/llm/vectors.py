"""Near-duplicate embeddings: a subspace pigeonhole join.

Unit vectors with cosine c are at squared distance 2 - 2c. Rotated by a random rotation, which spreads
distance evenly, and split into blocks, two vectors within the whole budget are within a block's share of
it (in proportion to its width) in at least one block. Each block is joined by range, the pairs within its
budget are verified with all coordinates in double precision, and counted where their first such block is.

Where vectors gather, a block's space is cut in the widest gaps of a few coordinates into cells: a vector lives
in its cell and visits the cells whose half-spaces are within the block's budget. Where they do not, balls
of that size reach across every cut, and cells would copy each vector more often than they spare it: then
vectors meet in tiles, each pair of tiles once, and all blocks are joined there. A sample tells which is less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkboard.llm.links import LIVES, VISITS, Forest, blocks, components, in_tiles, paired
from sparkboard.llm.shared import column, dropped, saved, smallest_hash

#: Added to the budgets: far above the error of squared distances in double precision.
SLACK = 1e-9
#: How much wider than a budget the screen in single precision is: far above its error for unit vectors.
SCREEN = 1e-4
#: Pairs verified at a time.
PAIRS = 1 << 16
#: Vectors on a side of a tile at most, and at least if all vectors fill a few tiles.
TILE, SMALL = 65_536, 4_096
#: Sides of tiles aimed at, so that a table of moderate size is several tasks.
SIDES = 4


def rotation(width: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def widest_gap(values: np.ndarray) -> float:
    """The middle of the widest gap between values of the middle half."""
    ordered = np.sort(values)
    middle = ordered[len(ordered) // 4:3 * len(ordered) // 4 + 1]
    if len(middle) < 2:
        return float(ordered[len(ordered) // 2])
    at = int(np.argmax(np.diff(middle)))
    return float(middle[at] + middle[at + 1]) / 2


class Blocks:
    """The split of rotated vectors, its budgets and cuts."""

    def __init__(self, width: int, cosine: float, n_blocks: int, depth: int, sample: np.ndarray) -> None:
        self.turn = rotation(width).astype(np.float64)
        edges = np.linspace(0, width, min(n_blocks, width) + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(edges, edges[1:])]
        self.budgets = [(2 - 2 * cosine) * (p.stop - p.start) / width + SLACK for p in self.parts]
        turned = unit(sample) @ self.turn if len(sample) else np.zeros((1, width))
        self.cuts = [np.array([widest_gap(turned[:, c]) for c in range(p.start, min(p.stop, p.start + depth))]) for p in self.parts]

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        return unit(vectors) @ self.turn

    def pays(self, sample: np.ndarray, sides: int) -> bool:
        """Whether cells copy and compare less than tiles of all vectors do, as a sample has it."""
        turned, copies, compared = self.turned(sample), 0, 0
        for k in range(len(self.parts)):
            for _, lives, visits in self.cells(turned, k):
                copies += len(lives) + len(visits)
                compared += len(lives) * (len(lives) + len(visits))
        return copies <= sides * len(sample) and 2 * compared <= len(self.parts) * len(sample) ** 2

    def cells(self, turned: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(cell, vectors which live there, vectors which visit it); of two cells the larger visits the smaller."""
        at = turned[:, self.parts[k]][:, : len(self.cuts[k])] - self.cuts[k]
        todo = [(0, 0, np.arange(len(turned)), np.arange(0), np.zeros(0))]
        while todo:
            level, cell, lives, visits, spent = todo.pop()
            if not len(lives) and not len(visits):
                continue
            if level == at.shape[1]:
                yield cell, lives, visits
                continue
            here, there = at[lives, level], at[visits, level]
            # Residents of the upper half visit the lower one; visitors go on wherever their budget reaches.
            across = np.concatenate([lives[here > 0], visits])
            cost = np.concatenate([here[here > 0] ** 2, spent + np.maximum(there, 0) ** 2])
            near = cost <= self.budgets[k]
            todo.append((level + 1, cell * 2, lives[here <= 0], across[near], cost[near]))
            cost = spent + np.minimum(there, 0) ** 2
            near = cost <= self.budgets[k]
            todo.append((level + 1, cell * 2 + 1, lives[here > 0], visits[near], cost[near]))


def usable(vectors, id_col: str, vector_col: str) -> DataFrame:
    """(vector, low, weight): distinct vectors that can be linked, the smallest id they have and how many rows."""
    rows = vectors.select(column(id_col).cast("long").alias("id"), column(vector_col).cast("array<float>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    nonzero = F.exists("vector", lambda x: x != 0)
    good = rows.where(F.col("id").isNotNull() & F.coalesce(finite & nonzero, F.lit(False)))
    return good.groupBy("vector").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("weight"))


def in_pairs_of_tiles(items: DataFrame, sides: int) -> DataFrame:
    """Rows (item, weight, vector) copied to the `sides` tiles they take part in; each two items meet in one tile."""
    h = F.pmod(F.xxhash64("item", F.lit(17)), F.lit(sides)).cast("int")
    places = F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), lambda k: F.struct(
        F.least(h, k).alias("i"), F.greatest(h, k).alias("j"), F.when(h == k, 2).when(h < k, 0).otherwise(1).alias("side")))
    return items.select("item", "weight", "vector", F.explode(places).alias("p")).select(
        F.lit(-1).cast("long").alias("shard"), "item", "weight", "vector", F.lit(False).alias("lives"), "p.*")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9,
    n_blocks: int = 4, cell: int = 16_384, sample: int = 10_000, cells: bool | None = None,
) -> DataFrame:
    """(id, n_links, component) per row.

    n_links: rows linked directly, equal vectors included; component: the smallest id reachable over links,
    the row's own included. Vectors that are null, empty, zero or hold a null or non-finite component link
    with nothing, nor do rows without an id. Shorter vectors count as filled up with zeros. Rows which
    repeat an id are rows of their own, in n_links and in components, linked only if their vectors are. The
    cuts between cells, and whether cells are used (unless `cells` says so), come from at most `sample`
    vectors and decide only where pairs meet.
    """
    # Numbered as it is written: distinct vectors are told apart by their numbers, not by ids.
    items = saved(usable(vectors, id_col, vector_col).withColumn("item", F.monotonically_increasing_id()), "vectors")
    n, width = items.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    width = width or 1

    def filled(column_of: pa.Array) -> np.ndarray:
        flat, ends = column_of.flatten().to_numpy(zero_copy_only=False), np.asarray(column_of.offsets)
        if len(flat) == width * len(column_of):
            return flat.reshape(-1, width)
        out, ends = np.zeros((len(column_of), width), np.float32), ends - ends[0]
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            out[k, : b - a] = flat[a:b]
        return out

    depth = max(0, int(np.ceil(np.log2(max(n, 1) / cell))))
    picked = smallest_hash(items.select("vector"), ["vector"], sample, n).collect() if depth else []
    fitted = np.zeros((len(picked), width), np.float32)
    for k, row in enumerate(picked):
        fitted[k, : len(row[0])] = row[0]
    split = Blocks(width, cosine, n_blocks, depth, fitted)
    sides = max(1, -(-n // TILE), min(SIDES, n // SMALL))
    if cells is None:
        cells = len(fitted) > 1 and split.pays(fitted, sides)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "role", "item", "weight", "vector"]
        for batch in batches:
            whole = filled(batch.column("vector"))
            item, weight = batch.column("item").to_numpy(), batch.column("weight").to_numpy()
            turned = split.turned(whole)
            for k in range(len(split.parts)):
                for at, lives, visits in split.cells(turned, k):
                    who = np.concatenate([lives, visits])
                    role = np.repeat(np.array([LIVES, VISITS], np.int32), [len(lives), len(visits)])
                    ends = np.arange(len(who) + 1, dtype=np.int32) * (4 * width)
                    raw = pa.Array.from_buffers(pa.binary(), len(who), [None, pa.py_buffer(ends), pa.py_buffer(whole[who].astype("<f4"))])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), k << 32 | at, np.int64)), pa.array(role), pa.array(item[who]), pa.array(weight[who]), raw], names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = filled(batch.column("vector"))
            ends = np.arange(len(whole) + 1, dtype=np.int32) * (4 * width)
            raw = pa.Array.from_buffers(pa.binary(), len(whole), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(whole, "<f4"))])
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("weight"), raw], ["item", "weight", "vector"])

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
        shard = int(right["shard"].iloc[0])
        rows = pd.concat([left, right]).drop_duplicates("item")
        ids = np.sort(rows["item"].to_numpy())
        rows = rows.set_index("item").loc[ids]
        whole = unit(np.frombuffer(b"".join(rows["vector"]), np.float32).reshape(-1, width))
        weight, turned = rows["weight"].to_numpy(), whole @ split.turn
        a, b = (np.searchsorted(ids, x["item"].to_numpy()) for x in (left, right))
        resident = np.zeros(len(ids), bool)
        # Two residents meet twice, as (x, y) and (y, x): the smaller on the left counts. `lives` marks residents.
        resident[np.searchsorted(ids, right.loc[right["lives"], "item"].to_numpy())] = True
        resident[a] = True
        links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        def within(x: np.ndarray, y: np.ndarray, m: int) -> np.ndarray:
            gap = turned[x, split.parts[m]] - turned[y, split.parts[m]]
            return np.einsum("ij,ij->i", gap, gap) <= split.budgets[m]

        for k in [shard >> 32] if shard >= 0 else range(len(split.parts)):
            # One product gives the block's squared distances: (-2x, x.x, 1) . (y, 1, y.y). In single precision,
            # it is a screen a little wider than the budget.
            own = turned[:, split.parts[k]]
            square, one = (own * own).sum(axis=1, keepdims=True), np.ones((len(ids), 1))
            screen_left = np.hstack([-2 * own, square, one]).astype(np.float32)[a]
            screen_right = np.hstack([own, one, square]).astype(np.float32)[b].T.copy()
            limit = np.float32(split.budgets[k] + SCREEN)
            for s, t in blocks(len(a), len(b), 512, 2048):
                hits = np.flatnonzero((screen_left[s] @ screen_right[:, t]).ravel() <= limit)
                for at in range(0, len(hits), PAIRS):
                    i, j = np.divmod(hits[at:at + PAIRS], t.stop - t.start)
                    x, y = a[s][i], b[t][j]
                    for test in (lambda: ~resident[y] | (x < y), lambda: within(x, y, k), lambda: np.einsum("ij,ij->i", whole[x], whole[y]) >= cosine):
                        good = test()
                        x, y = x[good], y[good]
                    if not len(x):
                        continue
                    forest.join(x, y)
                    for m in range(k):  # counted in that block
                        first = ~within(x, y, m)
                        x, y = x[first], y[first]
                    links += np.bincount(x, weight[y], len(ids)).astype(np.int64) + np.bincount(y, weight[x], len(ids)).astype(np.int64)
        found = np.nonzero((links > 0) | (forest.label != np.arange(len(ids))))[0]
        return pd.DataFrame({"a": ids[found], "b": ids[forest.label[found]], "links": links[found]})

    if cells:
        routed = saved(items.mapInArrow(route, "shard long, role int, item long, weight long, vector binary"), "routed")
        tiles = in_tiles(routed.withColumn("lives", F.col("role") == LIVES), TILE)
    else:
        tiles = in_pairs_of_tiles(items.mapInArrow(packed, "item long, weight long, vector binary"), sides)
    found = saved(paired(tiles, compare, "a long, b long, links long"), "vector-links")
    if cells:
        dropped(routed)
    joined = components(found.where("a <> b").select("a", "b"), "vector-components")
    totals = found.groupBy("a").agg(F.sum("links").alias("others"))
    roots = items.join(joined, items["item"] == joined["node"], "left").select("item", "low", "weight", "vector", F.coalesce("component", "item").alias("root"))
    lowest = roots.groupBy("root").agg(F.min("low").alias("c"))
    per_item = (
        roots.join(totals, roots["item"] == totals["a"], "left").join(lowest, "root")
        .select("vector", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n"), "c")
    )
    rows = vectors.select(column(id_col).cast("long").alias("id"), column(vector_col).cast("array<float>").alias("vector"))
    # Vectors are compared as they are grouped: the same digest of the same floats.
    rows = rows.join(per_item, (rows["vector"] == per_item["vector"]) & rows["id"].isNotNull(), "left")
    return rows.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component"))

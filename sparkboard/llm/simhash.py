"""SimHash near-duplicates: fingerprints of word shingles, compared through vantage-point trees.

`fingerprints` gives each text a fingerprint. `near_classes` links fingerprints which differ in a few
bits. The bits are split into as many ranges as there are trees; of two fingerprints within distance d,
one range differs in at most d // trees bits. Each tree parts a range's values by their Hamming distance
from vantage points, at the median; its leaves are the shards. A fingerprint lives in one leaf and visits
the leaves on the other side of a boundary nearer than the radius (triangle inequality), so that every
pair meets in a leaf, where the whole fingerprints are compared. The trees are grown from a bounded
sample and only decide who meets where: the pairs found do not depend on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sparkboard.llm.links import LIVES, VISITS, Forest, blocks, components, in_tiles, paired
from sparkboard.llm.shared import column, free_name, saved, smallest_hash

#: Shingles whose bits are counted at a time.
AT_ONCE = 65_536


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64 bits: each the majority of that bit over the hashes of all shingles. No words: zero."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[shingle - 1:].tolist() or [len(line)]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(stops), AT_ONCE):
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts[at:at + AT_ONCE], stops[at:at + AT_ONCE])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(stops), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, digest: bool = False) -> DataFrame:
    """(id, fp) per row; fp is the fingerprint as a signed long. Null and wordless texts have fingerprint 0.

    Repeated rows each give a row; other columns are not read. With `digest` a column of that name tells texts apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = [fingerprint(t.as_py(), shingle) if t.is_valid else 0 for t in texts]
            fps = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, *batch.columns[2:]], ["id", "fp", *batch.schema.names[2:]])

    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    if digest:
        rows = rows.withColumn("digest", F.xxhash64("text"))
    return rows.mapInArrow(run, "id long, fp long" + ", digest long" * digest)


@dataclass(frozen=True)
class Tree:
    """Vantage points over a range of bits. Node k has children 2k + 1 and 2k + 2; threshold -1 ends a branch."""

    low: int
    bits: int
    radius: int
    vantage: np.ndarray
    threshold: np.ndarray

    def values(self, fps: np.ndarray) -> np.ndarray:
        return (fps >> np.uint64(self.low)) & np.uint64((1 << self.bits) - 1)

    def route(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, indices which live there, indices which visit it)."""
        values = self.values(fps)
        # Of a pair which a boundary parts, the one beyond it visits; visitors go on to both sides.
        todo = [(0, np.arange(len(fps)), np.arange(0))]
        while todo:
            node, lives, visits = todo.pop()
            if not len(lives) and not len(visits):
                continue
            if node >= len(self.threshold) or self.threshold[node] < 0:
                yield node, lives, visits
                continue
            cut, v = self.threshold[node], self.vantage[node]
            here, there = np.bitwise_count(values[lives] ^ v), np.bitwise_count(values[visits] ^ v)
            crossing = lives[(here > cut) & (here <= cut + self.radius)]
            todo.append((2 * node + 1, lives[here <= cut], np.concatenate([crossing, visits[there <= cut + self.radius]])))
            todo.append((2 * node + 2, lives[here > cut], visits[there.astype(int) > cut - self.radius]))


def grow(sample: np.ndarray, low: int, bits: int, radius: int, depth: int) -> Tree:
    """A tree from sampled fingerprints: of a few candidates, the vantage point with the evenest parting."""
    nodes = (1 << depth) - 1
    tree = Tree(low, bits, radius, np.zeros(nodes, np.uint64), np.full(nodes, -1, np.int64))
    todo = [(0, np.unique(tree.values(sample)))]
    while todo:
        node, values = todo.pop()
        if node >= nodes or len(values) < 8:
            continue
        best = None
        for v in values[:: max(1, len(values) // 5)][:5]:
            away = np.bitwise_count(values ^ v).astype(int)
            cut = int(np.median(away))
            cut -= bool(cut) and abs((away < cut).mean() - 0.5) < abs((away <= cut).mean() - 0.5)
            crossed = ((away > cut) & (away <= cut + radius)).mean()
            cost = abs((away <= cut).mean() - 0.5) + crossed
            if (away > cut).any() and (best is None or cost < best[0]):
                best = cost, v, cut, away
        if best is None:
            continue
        _, tree.vantage[node], tree.threshold[node], away = best
        todo += [(2 * node + 1, values[away <= best[2]]), (2 * node + 2, values[away > best[2]])]
    return tree


def near_classes(
    fps: DataFrame, distance: int = 4, trees: int = 3, leaf: int = 512, sample: int = 65_536
) -> DataFrame:
    """(fp, component) for every distinct fingerprint: the smallest of those it is linked to.

    `fps` has a column fp. Equal fingerprints meet once, as one item. `leaf` is the size of a shard aimed
    at; depth grows with the table, at most to what `sample` fingerprints can part.
    """
    items = saved(fps.select("fp").distinct(), "fingerprints")
    n = items.count()
    depth = max(0, min(int(np.ceil(np.log2(max(n, 1) / leaf))), int(np.log2(sample)) - 4))
    picked = np.array([r[0] for r in smallest_hash(items, ["fp"], sample, n).collect()], np.int64).view(np.uint64) if depth else np.zeros(0, np.uint64)
    edges = np.linspace(0, 64, trees + 1).astype(int)
    grown = [grow(picked, int(a), int(b - a), distance // trees, depth) for a, b in zip(edges, edges[1:])]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column(0).to_numpy(zero_copy_only=False)
            for k, tree in enumerate(grown):
                shard, role, item = [], [], []
                for leaf_no, lives, visits in tree.route(signed.view(np.uint64)):
                    who = np.concatenate([lives, visits])
                    item.append(signed[who])
                    shard.append(np.full(len(who), k << 32 | leaf_no, np.int64))
                    role.append(np.repeat(np.array([LIVES, VISITS], np.int32), [len(lives), len(visits)]))
                if item:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (shard, role, item)], ["shard", "role", "item"])

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        both = np.unique(np.concatenate([left["item"], right["item"]]))
        a, b = (np.searchsorted(both, x["item"].to_numpy()) for x in (left, right))
        bits, forest = both.view(np.uint64), Forest(len(both))
        for x, y in blocks(len(a), len(b)):
            near = np.bitwise_count(bits[a[x]][:, None] ^ bits[b[y]][None, :]) <= distance
            i, j = np.nonzero(near)
            forest.join(a[x][i], b[y][j])
        linked = np.nonzero(forest.label != np.arange(len(both)))[0]
        return pd.DataFrame({"a": both[linked], "b": both[forest.label[linked]]})

    # A shard's rows in one place: its size, its tiles and the tasks over them follow from the same table.
    routed = saved(items.mapInArrow(route, "shard long, role int, item long"), "routed")
    links = paired(in_tiles(routed), compare, "a long, b long")
    found = components(links, "simhash-links")
    return items.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, trees: int = 3
) -> DataFrame:
    """(id, fp, component) per row: component is the smallest id reachable over links, its own included.

    Rows of equal fingerprints are linked, those without a word (fingerprint 0) included. Rows with a null
    id have a component but are nobody's smallest id; a component of such rows alone is null.
    """
    prints = saved(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = near_classes(prints, distance, trees).withColumnRenamed("component", "root")
    # One row per fingerprint and one per component, so that a large group joins as one row.
    heads = prints.groupBy("fp").agg(F.min("id").alias("head")).join(classes, "fp")
    lowest = heads.groupBy("root").agg(F.min("head").alias("component"))
    return prints.join(heads.join(lowest, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, trees: int = 3
) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id, all columns as they were.

    Rows which repeat an id with texts that are no near-duplicates are in groups of their own and all stay; of rows
    equal in id and text one stays. Rows without an id stay: they cannot be told apart.
    """
    prints = saved(fingerprints(docs, id_col, text_col, shingle, digest=True), "simhash")
    classes = near_classes(prints, distance, trees).withColumnRenamed("component", "root")
    # One row per fingerprint and one per group, so that a large group joins as one row.
    heads = prints.where("id is not null").groupBy("fp").agg(F.min(F.struct("id", "digest")).alias("head"))
    kept = heads.join(classes, "fp").groupBy("root").agg(F.min("head").alias("head"))
    own, text = free_name("__digest", docs.columns), column(text_col).cast("string")
    kept_id, kept_digest = (free_name(name, docs.columns) for name in ("__kept_id", "__kept_digest"))
    kept = kept.select(F.col("head.id").alias(kept_id), F.col("head.digest").alias(kept_digest))
    rows = docs.withColumn(own, F.xxhash64(text))
    this = (column(id_col).cast("long") == F.col(kept_id)) & (F.col(own) == F.col(kept_digest))
    first = rows.join(kept, this, "left_semi").dropDuplicates([id_col, own]).drop(own)
    return first.unionByName(docs.where(column(id_col).isNull()))


def hexadecimal(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")

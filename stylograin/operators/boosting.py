"""Boosted symmetric trees over binned features.

Training rows become blocks: per row the bins of its features other than the bin of zero, so that sparse
vectors stay sparse. A level of a tree is one aggregate over the blocks: the gradients and
curvatures per (leaf, feature, bin), of the right halves of the leaves only; the left halves are what is
left of the level before. All leaves of a level share one split (feature and cut), the one of the largest
gain; leaf values are Newton steps. A tree needs as many aggregates as it has levels.

Blocks are files in the shared folder that tasks map, so an aggregate moves the tree so far and the sums, and no rows.
Margins are written every ``REFRESH`` rounds; in between, the few trees since then are added up again by each aggregate,
which costs less than the sums themselves and needs nothing that a lost executor could take along. One block needs
no exchange: then its task grows all trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylograin.operators.blocks import block_count, block_folder, load_array, over_blocks, save_array, save_block, summed
from stylograin.session import importable_on_workers

BLOCK_ENTRIES = 4_000_000
REFRESH = 10


@dataclass
class Tree:
    """Splits of all levels, and one value per leaf; the first split is the lowest bit of a leaf's number."""

    slots: list[int] = field(default_factory=list)
    bins: list[int] = field(default_factory=list)  # rows with a larger bin go right
    gains: list[float] = field(default_factory=list)
    values: np.ndarray | None = None


@dataclass
class Grid:
    """Cut points of each feature, and where its bins lie on one axis over all features."""

    cuts: list[np.ndarray]

    def __post_init__(self):
        self.first = np.concatenate([[0], np.cumsum([len(c) + 1 for c in self.cuts])]).astype(np.int64)
        self.zero = np.array([np.searchsorted(c, 0.0) for c in self.cuts], np.int64)
        self.total = int(self.first[-1])

    def binned(self, slots: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.empty(len(slots), np.int64)
        order = np.argsort(slots, kind="stable")
        ends = np.searchsorted(slots[order], np.arange(len(self.cuts) + 1))
        for slot in np.flatnonzero(np.diff(ends)).tolist():
            rows = order[ends[slot]:ends[slot + 1]]
            out[rows] = np.searchsorted(self.cuts[slot], values[rows])
        return out


class Block:
    """Rows of one block with their margins, and the leaf of each in the tree that grows."""

    def __init__(self, path: str, grid: Grid, margin: str = "margin0"):
        self.grid = grid
        self.y, self.weight, self.margin = load_array(path, "y"), load_array(path, "weight"), load_array(path, margin).copy()
        self.n = len(self.y)
        self.row_of, self.cell = load_array(path, "row_of"), load_array(path, "cell")
        # The same entries slot by slot, each slot's end, and their bins.
        self.rows, self.slot_ends, self.bins = (load_array(path, name) for name in ("rows", "slot_ends", "bins"))
        self.start_tree()

    def start_tree(self) -> None:
        p = 1 / (1 + np.exp(-self.margin))
        self.gradient, self.curvature = self.weight * (p - self.y), self.weight * p * (1 - p)
        self.leaf, self.depth = np.zeros(self.n, np.int64), 0

    def goes_right(self, slot: int, cut: int) -> np.ndarray:
        some = slice(self.slot_ends[slot], self.slot_ends[slot + 1])
        right = np.full(self.n, self.grid.zero[slot] > cut)
        right[self.rows[some]] = self.bins[some] > cut
        return right

    def split(self, slot: int, cut: int) -> None:
        self.leaf |= self.goes_right(slot, cut).astype(np.int64) << self.depth
        self.depth += 1

    def add(self, tree: Tree) -> None:
        self.leaf, self.depth = np.zeros(self.n, np.int64), 0
        for slot, cut in zip(tree.slots, tree.bins):
            self.split(slot, cut)
        self.margin += tree.values[self.leaf]

    def sums(self) -> np.ndarray:
        """(2, leaves, bins of all features) sums of gradient and curvature, of the leaves' right halves if there are any."""
        half = 1 << max(0, self.depth - 1)
        wanted = self.leaf >= half if self.depth else np.ones(self.n, bool)
        entries = np.flatnonzero(wanted[self.row_of]) if self.depth else slice(None)
        row_of = self.row_of[entries]
        place = ((self.leaf & (half - 1)) * self.grid.total)[row_of] + self.cell[entries]
        out = np.empty((2, half, self.grid.total))
        for k, values in enumerate((self.gradient, self.curvature)):
            held = np.bincount(place, values[row_of], half * self.grid.total).astype(np.float64).reshape(half, -1)
            leaf = np.bincount(self.leaf[wanted] & (half - 1), values[wanted], half)
            held[:, self.grid.first[:-1] + self.grid.zero] += leaf[:, None] - np.add.reduceat(held, self.grid.first[:-1], axis=1)
            out[k] = held
        return out


def best_split(sums: np.ndarray, grid: Grid, l2: float) -> tuple[int, int, float, np.ndarray]:
    """Feature and bin of the largest gain over all leaves, that gain, and the leaves' sums (2, leaves, left and right) there."""
    upto = np.cumsum(sums, axis=2)
    before = np.concatenate([np.zeros((*sums.shape[:2], 1)), upto], axis=2)[:, :, grid.first[:-1]]
    whole = before[:, :, 1] if len(grid.cuts) > 1 else upto[:, :, -1]
    left = upto - np.repeat(before, np.diff(grid.first), axis=2)
    right = whole[:, :, None] - left

    def score(s):
        return s[0] ** 2 / (s[1] + l2)

    gain = (score(left) + score(right) - score(whole)[:, None]).sum(axis=0)
    gain[grid.first[1:] - 1] = -np.inf  # behind the last bin of a feature there is nothing
    at = int(np.argmax(gain))
    slot = int(np.searchsorted(grid.first, at, "right") - 1)
    return slot, at - int(grid.first[slot]), float(gain[at]), np.stack([left[:, :, at], right[:, :, at]], axis=2)


def grown(rounds: int, depth: int, rate: float, l2: float, grid: Grid, exchange: Callable[[Tree], np.ndarray],
          finished: Callable[[Tree], None]) -> list[Tree]:
    """All trees. ``exchange`` gives the sums over all blocks for the tree so far, ``finished`` takes a tree."""
    trees = []
    for _ in range(rounds):
        tree, sums, ends = Tree(), None, None
        for _ in range(depth):
            new = exchange(tree)
            if tree.slots:  # leaves of the left halves keep their number, those of the right follow
                new = np.concatenate([sums - new, new], axis=1)
            sums = new
            slot, cut, gain, halves = best_split(sums, grid, l2)
            if not gain > 1e-12:
                break
            tree.slots.append(slot)
            tree.bins.append(cut)
            tree.gains.append(gain)
            ends = np.concatenate([halves[:, :, 0], halves[:, :, 1]], axis=1)
        if not tree.slots:
            whole = sums[:, :, :grid.first[1]].sum(axis=2)
            ends = whole
        tree.values = -rate * ends[0] / (ends[1] + l2)
        trees.append(tree)
        finished(tree)
    return trees


def entries(features: str) -> F.Column:
    """The non-zero entries of a vector column as an array of (slot, value)."""
    inside = F.unwrap_udt(features)
    sparse = F.zip_with(inside["indices"], inside["values"], lambda i, v: F.struct(i.cast("int").alias("slot"), v.alias("value")))
    dense = F.transform(inside["values"], lambda v, i: F.struct(i.cast("int").alias("slot"), v.alias("value")))
    return F.filter(F.when(inside["type"] == 0, sparse).otherwise(dense), lambda e: e["value"] != 0)


def grid_of(rows: DataFrame, size: int, bins: int) -> tuple[Grid, int]:
    """Cuts at quantiles of the non-zero values and at zero, and the number of non-zero entries."""
    shares = [k / bins for k in range(1, bins)]
    exploded = rows.select(F.explode("entries").alias("e")).select("e.*")
    found = exploded.groupBy("slot").agg(F.percentile_approx("value", shares, 10_000).alias("cuts"), F.count(F.lit(1)).alias("n")).collect()
    cuts = [np.zeros(1)] * size
    for r in found:  # one row per feature
        cuts[r.slot] = np.unique([*r.cuts, 0.0])
    return Grid(cuts), sum(r.n for r in found)


def blocks_of(rows: DataFrame, grid: Grid, n_blocks: int) -> list[str]:
    """Paths of the blocks."""
    folder = block_folder(rows.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        held = table.column("entries").combine_chunks()
        flat = held.flatten()
        lengths = np.diff(held.offsets.to_numpy())
        slots, values = flat.field("slot").to_numpy(), flat.field("value").to_numpy()
        bins = grid.binned(slots, values)
        kept = bins != grid.zero[slots]
        row_of, slots, bins = np.repeat(np.arange(table.num_rows), lengths)[kept].astype(np.int32), slots[kept], bins[kept]
        by_slot = np.argsort(slots, kind="stable")  # once, not for each sum
        doubles = {name: table.column(name).to_numpy().astype(np.float64) for name in ("y", "weight")}
        yield pa.RecordBatch.from_pylist([{"path": save_block(folder, {
            "row_of": row_of, "cell": (grid.first[slots] + bins).astype(np.int32), "rows": row_of[by_slot], "bins": bins[by_slot].astype(np.uint8),
            "slot_ends": np.searchsorted(slots[by_slot], np.arange(len(grid.cuts) + 1)), **doubles, "margin0": np.zeros(table.num_rows)})}])

    return [r.path for r in rows.repartition(n_blocks).mapInArrow(pack, "path string").collect()]  # one per block


def fitted(rows: DataFrame, rounds: int, depth: int, rate: float, l2: float, bins: int, features: str, label: str, weight: str,
           block_entries: int = BLOCK_ENTRIES) -> BoostedTreesModel:
    spark = rows.sparkSession
    importable_on_workers(spark)
    if not 2 <= bins <= 255:
        raise ValueError("a feature has 2 to 255 bins")
    rows = rows.where(F.col(label).isNotNull()).select(entries(features).alias("entries"), F.col(label).cast("double").alias("y"),
                                                       F.col(weight).cast("double").alias("weight"), F.unwrap_udt(features).alias("_v"))
    size, n = rows.agg(F.max(F.coalesce(F.col("_v")["size"], F.size(F.col("_v")["values"]))), F.count(F.lit(1))).first()
    if not n:
        raise ValueError("no labelled rows to fit")
    rows = rows.drop("_v")
    grid, n_entries = grid_of(rows, size, bins - 1)  # zero may add a cut
    blocks = blocks_of(rows, grid, block_count(n_entries + 4 * n, block_entries, spark.sparkContext.defaultParallelism))

    def in_one_task(path: str) -> list[Tree]:
        block = Block(path, grid)

        def exchange(tree: Tree) -> np.ndarray:
            if tree.slots:
                block.split(tree.slots[-1], tree.bins[-1])
            return block.sums()

        def finished(tree: Tree) -> None:
            block.add(tree)
            block.start_tree()

        return grown(rounds, depth, rate, l2, grid, exchange, finished)

    if len(blocks) == 1:
        return BoostedTreesModel(over_blocks(spark, blocks, in_one_task)[0], grid.cuts, features)

    state = {"margin": "margin0", "since": [], "rounds": 0}

    def exchange(tree: Tree) -> np.ndarray:
        margin, since, so_far = state["margin"], list(state["since"]), list(zip(tree.slots, tree.bins))

        def add_up(path: str) -> np.ndarray:
            block = Block(path, grid, margin)
            for t in since:
                block.add(t)
            block.start_tree()
            for slot, cut in so_far:
                block.split(slot, cut)
            return block.sums()

        return summed(spark, blocks, add_up)

    def finished(tree: Tree) -> None:
        state["since"].append(tree)
        state["rounds"] += 1
        if len(state["since"]) == REFRESH:
            margin, since, name = state["margin"], list(state["since"]), f"margin{state['rounds']}"

            def refresh(path: str) -> None:  # under a new name, so that a second attempt finds what the first one found
                block = Block(path, grid, margin)
                for t in since:
                    block.add(t)
                save_array(path, name, block.margin)

            over_blocks(spark, blocks, refresh)
            state["margin"], state["since"] = name, []

    return BoostedTreesModel(grown(rounds, depth, rate, l2, grid, exchange, finished), grid.cuts, features)


class BoostedTreesModel:
    """Symmetric trees; scores rows in Arrow batches, from the features that the trees use."""

    def __init__(self, trees: Sequence[Tree], cuts: Sequence[np.ndarray], features: str):
        self.trees, self.features, self.size = list(trees), features, len(cuts)
        self.thresholds = [[float(cuts[s][b]) for s, b in zip(t.slots, t.bins)] for t in self.trees]
        self.used = sorted({s for t in self.trees for s in t.slots})

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - as Spark ML's tree models name it
        """Share of each feature in all gains."""
        gains = np.zeros(self.size)
        for t in self.trees:
            np.add.at(gains, t.slots, t.gains)
        return DenseVector(gains / gains.sum() if gains.sum() > 0 else gains)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Margins of rows that hold the used features."""
        place = {s: k for k, s in enumerate(self.used)}
        out = np.zeros(len(x))
        for tree, thresholds in zip(self.trees, self.thresholds):
            leaf = np.zeros(len(x), np.int64)
            for k, (slot, threshold) in enumerate(zip(tree.slots, thresholds)):
                leaf |= (x[:, place[slot]] > threshold).astype(np.int64) << k
            out += tree.values[leaf]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        importable_on_workers(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def margin(rows):
            import pandas as pd

            model = shared.value
            return pd.Series(model.margins(np.stack(rows.to_numpy()).reshape(len(rows), -1) if len(rows) else np.empty((0, len(model.used)))))

        every = vector_to_array(self.features)
        x = F.transform(F.lit(self.used or [0]), lambda i: F.get(every, i))
        raw = df.withColumn("_margin", margin(x))
        p = 1 / (1 + F.exp(-F.col("_margin")))
        return (raw.withColumn("rawPrediction", array_to_vector(F.array(-F.col("_margin"), F.col("_margin"))))
                .withColumn("probability", array_to_vector(F.array(1 - p, p)))
                .withColumn("prediction", (F.col("_margin") > 0).cast("double")).drop("_margin"))

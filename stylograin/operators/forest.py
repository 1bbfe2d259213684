"""Random forests over binned features.

Training rows become blocks of files in the shared folder: a byte per row and feature. A row's weight in a tree's
bootstrap and the features that a node may split on are hashes of (tree, row) and (tree, node), so no task needs
to be told them. Nodes with many rows are split from one sum over the blocks per level: weights and rows per (node,
feature, bin). A node of at most ``LOCAL_BYTES`` belongs to one task, which grows the rest of the tree below it.
Either way gives the same tree. A level costs what its rows cost, and no sum is held for nodes of few rows, so the
time grows with the rows and the depth, not with the number of nodes.

Finished trees are files too: a forest over many rows has millions of nodes, which tasks map and neither the driver
nor a broadcast holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylograin.operators.blocks import block_count, block_folder, load_array, over_blocks, save_block, summed
from stylograin.operators.boosting import Grid, entries, grid_of
from stylograin.session import batches_of_texts, importable_on_workers

BINS = 32
BLOCK_BYTES = 8_000_000
LOCAL_BYTES = 64_000_000
CELLS = 1 << 19  # of a table of sums in a task
PIECE = 1 << 19  # entries added to it at once
LEVEL_CELLS = 1 << 21  # of the sums over all blocks that one job brings to the driver
POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(12)])
NODE = np.dtype([("slot", "i4"), ("left", "i4"), ("bin", "u1"), ("gain", "f8"), ("human", "f8"), ("machine", "f8")])


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes (splitmix64)."""
    x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tree_key(seed: int, tree: int) -> np.uint64:
    return mixed(mixed(np.array([seed])) + np.uint64(tree))[0]


def drawn(key: np.uint64, first: int, n: int) -> np.ndarray:
    """How often each of ``n`` rows from number ``first`` on is in a tree's bootstrap: Poisson counts of mean 1."""
    u = (mixed(mixed(np.arange(first, first + n)) ^ key) >> np.uint64(11)) * 2.0 ** -53
    return np.searchsorted(POISSON, u, "right")


def candidates(key: np.uint64, ids: np.ndarray, size: int, k: int) -> np.ndarray:
    """``k`` of ``size`` features for each node, ascending."""
    out = np.empty((len(ids), k), np.int64)
    nodes = mixed(mixed(ids) ^ key)
    step = max(1, CELLS // size)
    for at in range(0, len(ids), step):
        order = mixed(nodes[at:at + step, None] + np.arange(size, dtype=np.uint64))
        out[at:at + step] = np.argpartition(order, k - 1, axis=1)[:, :k] if k < size else np.arange(size)
    return np.sort(out, axis=1)


class Growth:
    """A tree, or what is below a node of one, level by level. ``open`` are the nodes of the last level that may be split."""

    def __init__(self, key: np.uint64, size: int, depth: int, min_leaf: int, node: int, sums: np.ndarray):
        self.key, self.size, self.depth, self.min_leaf = key, size, depth, min_leaf
        self.tried = int(np.ceil(np.sqrt(size)))
        self.nodes, self.n, self.at_depth = [], 0, int(node).bit_length() - 1
        self.ids = np.array([node], np.int64)  # 1 is the root, 2 i and 2 i + 1 are the children of i
        self.place(self.ids, sums[None])

    def place(self, ids: np.ndarray, sums: np.ndarray) -> None:
        """Another level: nodes with their sums (human weight, machine weight, rows)."""
        level = np.zeros(len(ids), NODE)
        level["slot"], level["human"], level["machine"] = -1, sums[:, 0], sums[:, 1]
        self.nodes.append(level)
        self.first, self.n, self.ids, self.rows = self.n, self.n + len(ids), ids, sums[:, 2]
        may = (sums[:, 2] >= 2 * self.min_leaf) & (sums[:, 0] > 0) & (sums[:, 1] > 0)
        self.open = np.flatnonzero(may) if self.at_depth < self.depth else np.empty(0, np.int64)

    def features(self, which: np.ndarray) -> np.ndarray:
        return candidates(self.key, self.ids[which], self.size, self.tried)

    def split(self, which: np.ndarray, slot: np.ndarray, cut: np.ndarray, gain: np.ndarray, halves: np.ndarray) -> np.ndarray:
        """Split nodes of the last level where there is a gain, and begin the next. Gives each node's left child there, or -1."""
        level, good = self.nodes[-1], gain > 0
        children = np.full(len(level), -1, np.int64)
        children[which[good]] = 2 * np.arange(good.sum())
        level["slot"][which[good]], level["bin"][which[good]], level["gain"][which[good]] = slot[good], cut[good], gain[good]
        level["left"][which[good]] = self.n + children[which[good]]
        ids = self.ids[which[good]]
        self.at_depth += 1
        self.place(np.stack([2 * ids, 2 * ids + 1], axis=1).ravel(), halves[good].reshape(-1, 3))
        return children

    def table(self) -> np.ndarray:
        return np.concatenate(self.nodes)


def best_splits(sums: np.ndarray, features: np.ndarray, min_leaf: int) -> tuple[np.ndarray, ...]:
    """Per node the feature, bin and gain (of Gini impurity; 0 where none is allowed) of the best split, and the children's sums.

    ``sums`` are (3, nodes, features tried, bins): human weight, machine weight, rows.
    """
    left = np.cumsum(sums, axis=3)
    whole = left[:, :, :1, -1:]
    right = whole - left

    def score(s):
        total = s[0] + s[1]
        return np.divide(s[0] ** 2 + s[1] ** 2, total, out=np.zeros_like(total), where=total > 0)

    gain = score(left) + score(right) - score(whole)
    gain[(left[2] < min_leaf) | (right[2] < min_leaf)] = 0.0
    gain = gain.reshape(len(features), -1)
    at = np.argmax(gain, axis=1)
    node, place, cut = np.arange(len(features)), at // sums.shape[3], at % sums.shape[3]
    weight = (whole[0] + whole[1])[:, 0, 0]
    relative = gain[node, at] / weight
    halves = np.stack([left[:, node, place, cut].T, right[:, node, place, cut].T], axis=1)
    return features[node, place], cut, np.where(relative > 1e-12, relative, 0.0), halves


def node_sums(bins: np.ndarray, rows: np.ndarray, node: np.ndarray, features: np.ndarray, values: Sequence[np.ndarray]) -> np.ndarray:
    """(3, nodes, features tried, bins) sums of the values (human weight, machine weight, rows) over rows with their nodes."""
    n, tried = features.shape
    out = np.zeros((3, n * tried * BINS))
    step = max(1, PIECE // tried)
    for at in range(0, len(rows), step):
        some = slice(at, at + step)
        cell = bins[rows[some, None], features[node[some]]] + (node[some, None] * tried + np.arange(tried)) * BINS
        for k, v in enumerate(values):
            out[k] += np.bincount(cell.ravel(), np.repeat(v[some], tried), out.shape[1])
    return out.reshape(3, n, tried, BINS)


def grown(growth: Growth, bins: np.ndarray, rows: np.ndarray, values: Sequence[np.ndarray]) -> np.ndarray:
    """All nodes below the first one of ``growth``, to which ``rows`` belong."""
    node = np.zeros(len(rows), np.int64)
    while len(growth.open):
        may = growth.open
        rank = np.full(len(growth.ids), -1, np.int64)
        rank[may] = np.arange(len(may))
        node = rank[node]
        order = np.argsort(node, kind="stable")
        order = order[np.searchsorted(node[order], 0):]  # rows of closed nodes are done
        rows, node, values = rows[order], node[order], [v[order] for v in values]
        ends = np.searchsorted(node, np.arange(len(may) + 1))
        step = max(1, CELLS // (growth.tried * BINS))
        found = []
        for at in range(0, len(may), step):
            some = slice(ends[at], ends[min(at + step, len(may))])
            features = growth.features(may[at:at + step])
            sums = node_sums(bins, rows[some], node[some] - at, features, [v[some] for v in values])
            found.append(best_splits(sums, features, growth.min_leaf))
        slot, cut, gain, halves = (np.concatenate(parts) for parts in zip(*found))
        right = bins[rows, slot[node]] > cut[node]
        children = growth.split(may, slot, cut, gain, halves)[may]
        node, kept = children[node] + right, children[node] >= 0
        rows, node, values = rows[kept], node[kept], [v[kept] for v in values]
    return growth.table()


def descended(table: np.ndarray, bins: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The leaf of each row, from node ``at`` of ``table`` on."""
    at = at.copy()
    slots, lefts, cuts = (np.ascontiguousarray(table[name]) if len(table) < len(at) else table[name] for name in ("slot", "left", "bin"))
    inside = np.flatnonzero(slots[at] >= 0)
    while len(inside):
        here = at[inside]
        there = lefts[here] + (bins[rows[inside], slots[here]] > cuts[here])
        at[inside] = there
        inside = inside[slots[there] >= 0]
    return at


def joined(top: np.ndarray, below: dict[int, np.ndarray]) -> np.ndarray:
    """A tree whose nodes ``below`` are replaced by what has grown there."""
    parts, n = [top.copy()], len(top)
    for at, table in below.items():
        moved = table.copy()
        moved["left"] += np.where(moved["slot"] >= 0, n - 1, 0).astype(np.int32)  # its first node takes the old place
        parts[0][at] = moved[0]
        parts.append(moved[1:])
        n += len(table) - 1
    return np.concatenate(parts)


def pruned(table: np.ndarray) -> np.ndarray:
    """Two leaves of one parent that predict the same are one leaf, as in Spark's own forests."""
    table, gone = table.copy(), np.zeros(len(table), bool)
    while True:
        leaf, machine = table["slot"] < 0, table["machine"] > table["human"]
        inner = np.flatnonzero(~leaf & ~gone)
        left = table["left"][inner]
        merge = leaf[left] & leaf[left + 1] & (machine[left] == machine[left + 1])
        if not merge.any():
            break
        table["slot"][inner[merge]] = -1
        gone[left[merge]] = gone[left[merge] + 1] = True
    place = np.cumsum(~gone) - 1
    table["left"] = np.where(table["slot"] >= 0, place[table["left"]], 0)
    return table[~gone]


def importance(table: np.ndarray, size: int) -> np.ndarray:
    """Share of each feature in all gains of a tree, times the weight at the split."""
    inner = table[table["slot"] >= 0]
    gains = np.bincount(inner["slot"], inner["gain"] * (inner["human"] + inner["machine"]), size)
    return gains / gains.sum() if gains.sum() > 0 else gains


def binned_rows(held: pa.Array, grid: Grid) -> np.ndarray:
    """(rows, features) bins of an Arrow array of lists of (slot, value) without zeros."""
    flat, ends = held.flatten(), held.offsets.to_numpy()
    slots = flat.field("slot").to_numpy(zero_copy_only=False)
    out = np.tile(grid.zero.astype(np.uint8), (len(held), 1))
    out[np.repeat(np.arange(len(held)), np.diff(ends)), slots] = grid.binned(slots, flat.field("value").to_numpy(zero_copy_only=False))
    return out


def in_order(bins: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """An order of a block's rows that does not depend on how they arrived: a row's number decides in which bootstraps it is."""
    whole = np.concatenate([bins, y[:, None], weights[:, None].view(np.uint8)], axis=1)
    return np.argsort(whole.view(np.dtype((np.void, whole.shape[1]))).ravel(), kind="stable")


def weights_of(path: str, key: np.uint64, first: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows of a block that a tree has drawn, and their human weight, machine weight and number."""
    y, weight = load_array(path, "y"), load_array(path, "weight")
    times = drawn(key, first, len(y))
    rows = np.flatnonzero(times)
    w = weight[rows] * times[rows]
    return rows, [np.where(y[rows] > 0, 0.0, w), np.where(y[rows] > 0, w, 0.0), times[rows].astype(np.float64)]


class Trainer:
    """What all tasks of a fit share."""

    def __init__(self, spark: SparkSession, paths: Sequence[str], starts: Sequence[int], size: int, folder: str, trees: int, depth: int,
                 min_leaf: int, seed: int, local_bytes: int):
        self.paths, self.first, self.size, self.folder = list(paths), dict(zip(paths, starts)), size, folder
        self.trees, self.depth, self.min_leaf, self.seed, self.local_rows = trees, depth, min_leaf, seed, max(1, local_bytes // size)
        self.spark = spark

    def __getstate__(self):
        return self.__dict__ | {"spark": None}

    def growth(self, tree: int, node: int, sums: np.ndarray) -> Growth:
        return Growth(tree_key(self.seed, tree), self.size, self.depth, self.min_leaf, node, sums)

    def rows_at(self, path: str, tree: int, table: np.ndarray | None):
        """Bins, drawn rows, their nodes in the top of a tree and their values."""
        bins = load_array(path, "bins")
        rows, values = weights_of(path, tree_key(self.seed, tree), self.first[path])
        at = np.zeros(len(rows), np.int64)
        return bins, rows, descended(table, bins, at, rows) if table is not None else at, values

    def roots(self) -> np.ndarray:
        """(trees, 3) sums of all drawn rows."""
        me = self

        def add_up(path: str) -> np.ndarray:
            return np.array([[v.sum() for v in weights_of(path, tree_key(me.seed, t), me.first[path])[1]] for t in range(me.trees)])

        return summed(self.spark, self.paths, add_up)

    def tops(self) -> list[tuple[Growth, dict[int, int]]]:
        """Every tree down to nodes of few rows, and those nodes: place in the table to number."""
        growths = [self.growth(t, 1, sums) for t, sums in enumerate(self.roots())]
        waiting = [{} for _ in growths]
        while True:
            wanted = []  # (tree, nodes of its last level), as many as one job may bring back
            for t, g in enumerate(growths):
                many = g.rows[g.open] > self.local_rows
                waiting[t].update({int(g.first + k): int(g.ids[k]) for k in g.open[~many]})
                g.open = g.open[many]
                if len(g.open):
                    wanted.append((t, g.open))
            if not wanted:
                return list(zip(growths, waiting))
            step = max(1, LEVEL_CELLS // (growths[0].tried * BINS * 3))
            jobs = [[]]
            for t, which in wanted:
                for at in range(0, len(which), step):
                    if sum(len(w) for _, w in jobs[-1]) + len(which[at:at + step]) > step and jobs[-1]:
                        jobs.append([])
                    jobs[-1].append((t, which[at:at + step]))
            found = {}
            for job in jobs:
                asked = [(t, growths[t].table(), growths[t].first + which, growths[t].features(which)) for t, which in job]
                sums = self.sums(asked)
                at = 0
                for t, which in job:
                    features = growths[t].features(which)
                    found.setdefault(t, []).append(best_splits(sums[:, at:at + len(which)], features, self.min_leaf))
                    at += len(which)
            for t, which in wanted:
                growths[t].split(which, *(np.concatenate(parts) for parts in zip(*found[t])))

    def sums(self, asked: Sequence[tuple]) -> np.ndarray:
        """(3, nodes asked for, features tried, bins) over all blocks."""
        me = self

        def add_up(path: str, *held) -> np.ndarray:
            out = []
            for tree, table, places, features in held:
                bins, rows, at, values = me.rows_at(path, tree, table)
                rank = np.full(len(table), -1, np.int64)
                rank[places] = np.arange(len(places))
                node = rank[at]
                mine = np.flatnonzero(node >= 0)
                out.append(node_sums(bins, rows[mine], node[mine], features, [v[mine] for v in values]))
            return np.concatenate(out, axis=1)

        return summed(self.spark, self.paths, add_up, *asked)

    def below(self, tree: int, table: np.ndarray, place: int, node: int) -> np.ndarray:
        """What grows from one node of the top of a tree, out of that node's rows alone."""
        kept = []
        for path in self.paths:
            bins, rows, at, values = self.rows_at(path, tree, table)
            mine = np.flatnonzero(at == place)
            whole = len(self.paths) == 1
            kept.append((bins if whole else bins[rows[mine]], rows[mine], [v[mine] for v in values]))
        values = [np.concatenate(v) for v in zip(*(k[2] for k in kept))]
        bins, rows = (kept[0][0], kept[0][1]) if len(kept) == 1 else (np.concatenate([k[0] for k in kept]), np.arange(len(values[0])))
        return grown(self.growth(tree, node, np.array([v.sum() for v in values])), bins, rows, values)

    def whole(self, trees: Sequence[int]) -> Iterator[np.ndarray]:
        """Trees that a task grows from their roots, over rows that it holds once for all of them."""
        bins = [load_array(path, "bins") for path in self.paths]
        bins = bins[0] if len(bins) == 1 else np.concatenate(bins)
        starts = np.cumsum([0, *(len(load_array(path, "y")) for path in self.paths)])
        for tree in trees:
            held = [weights_of(path, tree_key(self.seed, tree), self.first[path]) for path in self.paths]
            rows = np.concatenate([r + at for (r, _), at in zip(held, starts)])
            values = [np.concatenate(v) for v in zip(*(h[1] for h in held))]
            yield grown(self.growth(tree, 1, np.array([v.sum() for v in values])), bins, rows, values)

    def saved(self, tables: Iterator[np.ndarray]) -> dict:
        """Trees in one file: its path, their first nodes, and their features' importance."""
        parts, roots, shares, n = [], [], np.zeros(self.size), 0
        for table in tables:
            table = pruned(table)
            shares += importance(table, self.size)
            table["left"] += n
            roots.append(n)
            parts.append(table)
            n += len(table)
        return {"path": save_block(self.folder, {"nodes": np.concatenate(parts), "roots": np.array(roots)}), "shares": shares, "n": n, "trees": len(roots)}

    def forest(self, n_rows: int) -> list[dict]:
        me, sc = self, self.spark.sparkContext
        tasks = min(self.trees, 4 * sc.defaultParallelism)
        dealt = [list(range(k, self.trees, tasks)) for k in range(tasks)]
        if n_rows <= self.local_rows:
            return over_blocks(self.spark, dealt, lambda trees: me.saved(me.whole(trees)))
        tops = self.tops()
        asked = [(t, g.table(), place, node) for t, (g, nodes) in enumerate(tops) for place, node in nodes.items()]
        pieces = sc.parallelize(asked, max(1, len(asked))).map(
            lambda a: (a[0], a[2], save_block(me.folder, {"nodes": me.below(*a)}))).collect() if asked else []
        below = {}
        for t, place, path in pieces:
            below.setdefault(t, {})[place] = path
        whole = [[(tops[t][0].table(), below.get(t, {})) for t in trees] for trees in dealt]
        return over_blocks(self.spark, whole, lambda trees: me.saved(
            joined(top, {place: load_array(path, "nodes") for place, path in found.items()}) for top, found in trees))


def fitted(rows: DataFrame, trees: int, depth: int, min_leaf: int, seed: int, features: str, label: str, weight: str,
           local_bytes: int = LOCAL_BYTES, block_bytes: int = BLOCK_BYTES) -> ForestModel:
    """Fit on rows whose label is 0 or 1; rows without a label are left out."""
    spark = rows.sparkSession
    importable_on_workers(spark)
    rows = rows.where(F.col(label).isNotNull()).select(entries(features).alias("entries"), F.col(label).cast("double").alias("y"),
                                                       F.col(weight).cast("double").alias("weight"), F.unwrap_udt(features).alias("_v"))
    size, n, n_other = rows.agg(F.max(F.coalesce(F.col("_v")["size"], F.size(F.col("_v")["values"]))), F.count(F.lit(1)),
                                F.count_if(~F.col("y").isin(0.0, 1.0))).first()
    if not n:
        raise ValueError("no labelled rows to fit")
    if n_other:
        raise ValueError("labels are 0 or 1")
    rows = rows.drop("_v")
    grid, _ = grid_of(rows, size, BINS - 1)  # zero may add a cut
    folder = block_folder(spark)

    def pack(batches: Iterator[pa.RecordBatch]):
        parts, y, weights = [], [], []
        for batch in batches:
            if batch.num_rows:
                parts.append(binned_rows(batch.column("entries"), grid))
                y.append(batch.column("y").to_numpy().astype(np.uint8))
                weights.append(batch.column("weight").to_numpy().astype(np.float64))
        if parts:
            bins, y, weights = np.concatenate(parts), np.concatenate(y), np.concatenate(weights)
            order = in_order(bins, y, weights)
            path = save_block(folder, {"bins": bins[order], "y": y[order], "weight": weights[order]})
            yield pa.RecordBatch.from_pylist([{"path": path, "n": len(y)}])

    batches_of_texts(spark)
    n_blocks = block_count(n * size, block_bytes, spark.sparkContext.defaultParallelism)
    packed = rows.repartition(n_blocks).mapInArrow(pack, "path string, n bigint").collect()  # one row per block
    starts = np.cumsum([0, *(r.n for r in packed)])[:-1].tolist()
    trainer = Trainer(spark, [r.path for r in packed], starts, size, folder, trees, depth, min_leaf, seed, local_bytes)
    return ForestModel(trainer.forest(n), grid, features)


class ForestModel:
    """Trees in files; scores rows in Arrow batches, whose tasks map them."""

    def __init__(self, files: Sequence[dict], grid: Grid, features: str):
        self.paths, self.grid, self.features = [f["path"] for f in files], grid, features
        self.total_nodes, self.n_trees = sum(f["n"] for f in files), sum(f["trees"] for f in files)
        shares = np.sum([f["shares"] for f in files], axis=0)
        self.shares = shares / shares.sum() if shares.sum() > 0 else shares

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - as Spark ML's tree models name it
        """Mean over the trees of each feature's share in a tree's gains."""
        return DenseVector(self.shares)

    def scores(self, bins: np.ndarray) -> np.ndarray:
        """Mean over the trees of the machine share in a row's leaf."""
        total = np.zeros(len(bins))
        for path in self.paths:
            nodes, roots = load_array(path, "nodes"), load_array(path, "roots")
            rows = np.repeat(np.arange(len(bins)), len(roots))
            leaves = nodes[descended(nodes, bins, np.tile(roots, len(bins)), rows)]
            total += (leaves["machine"] / (leaves["human"] + leaves["machine"])).reshape(len(bins), -1).sum(axis=1)
        return total / self.n_trees

    def transform(self, df: DataFrame) -> DataFrame:
        importable_on_workers(df.sparkSession)
        batches_of_texts(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(rows):
            import pandas as pd

            model = shared.value
            if not len(rows):
                return pd.Series([], dtype="float64")
            x = np.stack(rows.to_numpy())
            bins = np.stack([np.searchsorted(cuts, x[:, k]) for k, cuts in enumerate(model.grid.cuts)], axis=1).astype(np.uint8)
            return pd.Series(model.scores(bins))

        p = F.col("_p")
        judged = df.withColumn("_p", score(vector_to_array(self.features)))
        return (judged.withColumn("rawPrediction", array_to_vector(F.array(self.n_trees * (1 - p), self.n_trees * p)))
                .withColumn("probability", array_to_vector(F.array(1 - p, p)))
                .withColumn("prediction", (p > 0.5).cast("double")).drop("_p"))

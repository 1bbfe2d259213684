import pickle
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from stylograin.operators import forest
from stylograin.operators import models as m


def data(n=300, features=5, seed=1):
    rng = random.Random(seed)
    x = [[round(rng.gauss(0, 1), 1) if rng.random() < .7 else 0.0 for _ in range(features)] for _ in range(n)]
    y = [int(a[0] * a[1] + .3 * a[2] + rng.gauss(0, .2) > 0) for a in x]
    return np.array(x), np.array(y), np.array([rng.choice([.5, 1, 2]) for _ in range(n)])


def table(spark, x, y, w, sparse=False):
    if sparse:
        rows = [(i, int(b), float(c), Vectors.sparse(len(a), {k: float(v) for k, v in enumerate(a) if v})) for i, (a, b, c) in enumerate(zip(x, y, w))]
        return spark.createDataFrame(rows, ["sample_id", "label", "weight", "features"])
    df = spark.createDataFrame([(i, int(b), float(c), a.tolist()) for i, (a, b, c) in enumerate(zip(x, y, w))], "sample_id long, label int, weight double, v array<double>")
    return df.withColumn("features", array_to_vector("v"))


def fit(df, trees=7, depth=6, min_leaf=3, **options):
    return forest.fitted(df, trees, depth, min_leaf, 42, "features", "label", "weight", **options)


def scores(model, df):
    return np.array([r.probability[1] for r in model.transform(df).orderBy("sample_id").collect()])


def plain(bins, y, w, times, key, depth, min_leaf):
    """The machine share of every row's leaf in one tree, by trying every cut with plain loops."""
    size = bins.shape[1]

    def gini_weight(rows):
        human, machine = (sum(w[r] * times[r] for r in rows if y[r] == k) for k in (0, 1))
        return (human ** 2 + machine ** 2) / (human + machine) if human + machine else 0.0, human, machine

    def grow(rows, node, level):
        whole, human, machine = gini_weight(rows)
        best = (1e-12 * (human + machine), None)
        if level < depth and human > 0 and machine > 0:
            for f in forest.candidates(key, np.array([node]), size, int(np.ceil(np.sqrt(size))))[0]:
                for cut in range(forest.BINS):
                    sides = [r for r in rows if bins[r, f] <= cut], [r for r in rows if bins[r, f] > cut]
                    if min(sum(times[r] for r in side) for side in sides) < min_leaf:
                        continue
                    gain = sum(gini_weight(side)[0] for side in sides) - whole
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut))
        if best[1] is None:
            return (machine > human, {r: machine / (human + machine) for r in rows}), (human, machine)
        f, cut = best[1]
        left, a = grow([r for r in rows if bins[r, f] <= cut], 2 * node, level + 1)
        right, b = grow([r for r in rows if bins[r, f] > cut], 2 * node + 1, level + 1)
        if left[0] is not None and left[0] == right[0]:
            return (left[0], {r: machine / (human + machine) for r in rows}), (human, machine)
        return (None, left[1] | right[1]), (human, machine)

    return grow(np.flatnonzero(times).tolist(), 1, 0)[0][1]


@pytest.mark.parametrize("tree", [0, 1, 2])
def test_equals_exhaustive_search(tree):
    x, y, w = data(120, 4)
    bins = np.clip(np.round(x * 4) + 16, 0, 31).astype(np.uint8)
    key = forest.tree_key(42, tree)
    times = forest.drawn(key, 0, len(y))
    rows = np.flatnonzero(times)
    values = [np.where(y[rows] == k, w[rows] * times[rows], 0.0) for k in (0, 1)] + [times[rows].astype(float)]
    found = forest.pruned(forest.grown(forest.Growth(key, 4, 5, 3, 1, np.array([v.sum() for v in values])), bins, rows, values))
    leaves = found[forest.descended(found, bins, np.zeros(len(rows), np.int64), rows)]
    expected = plain(bins, y, w, times, key, 5, 3)
    assert len(found) > 5
    assert leaves["machine"] / (leaves["human"] + leaves["machine"]) == pytest.approx([expected[r] for r in rows.tolist()])


def test_nodes_split_over_blocks_and_in_one_task_give_the_same_trees(spark, monkeypatch):
    x, y, w = data()
    df = table(spark, x, y, w).repartition(3).persist()
    df.count()
    whole = fit(df, block_bytes=300)
    for local in (1, 200, 700):  # bytes; every level over the blocks, or only the first ones
        parts = fit(df, block_bytes=300, local_bytes=local)
        assert scores(parts, df) == pytest.approx(scores(whole, df))
        assert parts.featureImportances.toArray() == pytest.approx(whole.featureImportances.toArray())
    monkeypatch.setattr(forest, "LEVEL_CELLS", 1)  # a job for each node
    assert scores(fit(df, trees=2, block_bytes=300, local_bytes=200), df) == pytest.approx(scores(fit(df, trees=2, block_bytes=300), df))
    df.unpersist()


def test_sparse_rows_give_the_same_trees(spark):
    x, y, w = data()
    dense, sparse = (table(spark, x, y, w, s).coalesce(1) for s in (False, True))
    assert scores(fit(sparse), sparse) == pytest.approx(scores(fit(dense), dense))


def test_the_order_of_rows_does_not_matter(spark):
    x, y, w = data()
    df = table(spark, x, y, w).coalesce(1)
    other = df.orderBy(F.desc("sample_id")).coalesce(1)
    assert (scores(fit(other), df) == scores(fit(df), df)).all()


def test_a_model_does_not_grow_with_its_trees(spark):
    x, _, w = data(3000)
    df = table(spark, x, np.arange(3000) * 7 % 11 % 2, w)  # labels that no feature tells
    small, large = m.random_forest(20, 2)(df), m.random_forest(20, 20)(df)
    assert large.total_nodes > 20 * small.total_nodes
    assert len(pickle.dumps(large)) < 1.2 * len(pickle.dumps(small))


def test_importance_and_odd_rows(spark):
    x, y, w = data(600, 6)
    df = table(spark, x, y, w)
    model = fit(df, 30, 8)
    shares = model.featureImportances.toArray()
    assert shares.sum() == pytest.approx(1) and set(np.argsort(-shares)[:3]) == {0, 1, 2}
    one = table(spark, np.zeros((20, 2)), np.ones(20), np.ones(20))
    assert (scores(fit(one), one) == 1).all() and fit(one).featureImportances.toArray().sum() == 0
    with_null = one.withColumn("label", F.when(F.col("sample_id") > 3, F.col("label")))
    assert (scores(fit(with_null), one) == 1).all()
    for bad in (one.limit(0), one.withColumn("label", F.lit(2))):
        with pytest.raises(ValueError):
            fit(bad)


def test_bootstrap_draws_each_row_once_on_average():
    times = np.array([forest.drawn(forest.tree_key(42, t), 0, 4000) for t in range(30)])
    assert abs(times.mean() - 1) < .02 and abs(times.var() - 1) < .03 and abs((times == 0).mean() - np.exp(-1)) < .01
    assert (forest.drawn(forest.tree_key(42, 3), 1000, 500) == times[3, 1000:1500]).all()
    tried = forest.candidates(forest.tree_key(42, 0), np.arange(1, 5001), 18, 5)
    assert (np.diff(tried, axis=1) > 0).all() and np.bincount(tried.ravel()) / 5000 == pytest.approx(5 / 18, abs=.03)

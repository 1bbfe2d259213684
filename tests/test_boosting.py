import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from stylograin.operators import boosting


def data(n=400, seed=1, features=5):
    rng = random.Random(seed)
    x = [[round(rng.gauss(0, 1), 1) if rng.random() < .7 else 0.0 for _ in range(features)] for _ in range(n)]
    y = [int(a[0] * a[1] + .3 * a[2] + rng.gauss(0, .2) > 0) for a in x]
    return np.array(x), np.array(y, float), np.array([rng.choice([.5, 1, 2]) for _ in range(n)])


def table(spark, x, y, w, sparse=False):
    if sparse:
        rows = [(i, float(b), float(c), Vectors.sparse(len(a), {k: float(v) for k, v in enumerate(a) if v})) for i, (a, b, c) in enumerate(zip(x, y, w))]
        return spark.createDataFrame(rows, ["sample_id", "label", "weight", "features"])
    df = spark.createDataFrame([(i, a.tolist(), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w))], "sample_id long, v array<double>, label double, weight double")
    return df.withColumn("features", array_to_vector("v"))


def fit(df, rounds=12, depth=3, **options):
    return boosting.fitted(df, rounds, depth, 0.1, 3.0, options.pop("bins", 255), "features", "label", "weight", **options)


def exhaustive(x, y, w, rounds, depth, rate=0.1, l2=3.0):
    """Margins of the same trees by trying every value of every feature as a threshold, with plain loops."""
    margin = np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h, leaf = w * (p - y), w * p * (1 - p), [0] * len(y)
        for level in range(depth):
            best = (1e-12, None)
            for f in range(x.shape[1]):
                for c in sorted({*x[:, f], 0.0}):
                    gain = 0.0
                    for part in set(leaf):
                        mine = np.array([k for k in range(len(y)) if leaf[k] == part])
                        for side in (mine[x[mine, f] <= c], mine[x[mine, f] > c]):
                            gain += g[side].sum() ** 2 / (h[side].sum() + l2)
                        gain -= g[mine].sum() ** 2 / (h[mine].sum() + l2)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, c))
            if best[1] is None:
                break
            f, c = best[1]
            leaf = [part + (int(x[k, f] > c) << level) for k, part in enumerate(leaf)]
        values = {part: -rate * sum(g[k] for k in range(len(y)) if leaf[k] == part) / (sum(h[k] for k in range(len(y)) if leaf[k] == part) + l2) for part in set(leaf)}
        margin += [values[part] for part in leaf]
    return margin


def margins(model, df):
    return np.array([r.rawPrediction[1] for r in model.transform(df).orderBy("sample_id").collect()])


def test_equals_exhaustive_search(spark):
    x, y, w = data(60, features=3)
    df = table(spark, x, y, w)
    assert margins(fit(df, 4, 3), df) == pytest.approx(exhaustive(x, y, w, 4, 3))


def test_blocks_dense_and_sparse_rows_give_the_same_trees(spark):
    x, y, w = data()
    df = table(spark, x, y, w).persist()
    one = margins(fit(df), df)
    many = fit(df.repartition(5), block_entries=700)
    assert margins(many, df) == pytest.approx(one)
    assert margins(fit(table(spark, x, y, w, sparse=True)), df) == pytest.approx(one)
    df.unpersist()


def test_loss_falls_and_importance_finds_the_features(spark):
    x, y, w = data(600, features=6)
    df = table(spark, x, y, w)

    def loss(rounds):
        return sum(b * math.log1p(math.exp(-m if a else m)) for m, a, b in zip(margins(fit(df, rounds, 4, bins=32), df), y, w))

    losses = [loss(r) for r in (1, 10, 60)]
    assert losses == sorted(losses, reverse=True) and losses[-1] < .6 * losses[0]
    model = fit(df, 200, 4)
    assert model.featureImportances.toArray().sum() == pytest.approx(1)
    assert set(np.argsort(-model.featureImportances.toArray())[:3]) == {0, 1, 2}
    judged = model.transform(df).select("label", "prediction", F.col("probability")).collect()
    assert np.mean([r.label == r.prediction for r in judged]) > .9 and all(0 < r.probability[1] < 1 for r in judged)


def test_one_class_constant_features_and_nulls(spark):
    df = table(spark, np.zeros((20, 2)), np.ones(20), np.ones(20))
    model = fit(df, 5)
    assert (margins(model, df) > 0).all() and model.featureImportances.toArray().sum() == 0
    with_null = df.withColumn("label", F.when(F.col("sample_id") > 3, F.col("label")))
    assert (margins(fit(with_null, 5), df) > 0).all()
    with pytest.raises(ValueError):
        fit(df.limit(0))


def test_a_level_over_several_blocks_is_one_job_without_a_shuffle(spark):
    x, y, w = data()
    df = table(spark, x, y, w).repartition(5).persist()
    df.count()
    sc, jobs, stages = spark.sparkContext, [], []
    for rounds in (2, 5):
        sc.setJobGroup(f"boosting {rounds}", "")
        model = fit(df, rounds, 3, block_entries=700)
        tracker = sc.statusTracker()
        ids = tracker.getJobIdsForGroup(f"boosting {rounds}")
        jobs.append(len(ids))
        stages.append(sum(len(tracker.getJobInfo(i).stageIds) for i in ids))
        assert all(len(t.slots) == 3 for t in model.trees)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] == stages[1] - stages[0] == 9
    df.unpersist()

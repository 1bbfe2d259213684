import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from stylograin.operators import isotonic, linear


def data(n=300, d=6, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.choice([.1, 1, 20], d) * (rng.random((n, d)) < .6)
    y = (x @ rng.normal(size=d) + rng.normal(size=n) > .5).astype(float)
    return x, y, rng.choice([.5, 1, 3], n)


def table(spark, x, y, w, sparse=True):
    rows = [(i, float(b), float(c), Vectors.sparse(len(a), {k: float(v) for k, v in enumerate(a) if v}) if sparse else Vectors.dense(a.tolist()))
            for i, (a, b, c) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, ["sample_id", "label", "weight", "features"])


def fit(df, loss, tol, **options):
    return linear.fitted(df, loss, options.pop("c", 1.0), tol, 1000, "features", "label", "weight", **options)


def slope(x, y, w, beta, loss, c):
    """Gradient of the whole objective, written out."""
    s = 2 * y - 1
    agreed = s * (x @ beta[:-1] + beta[-1])
    pull = -s / (1 + np.exp(agreed)) if loss == linear.LOGISTIC else -2 * s * np.maximum(0, 1 - agreed)
    out = c * np.append(x.T @ (w * pull), (w * pull).sum())
    out[:-1] += beta[:-1]
    if loss != linear.LOGISTIC:
        out[-1] += beta[-1]
    return out


@pytest.mark.parametrize("loss", [linear.LOGISTIC, linear.SQUARED_HINGE])
@pytest.mark.parametrize("c", [0.01, 100.0])
def test_optimum_has_no_slope(spark, loss, c):
    x, y, w = data()
    model = fit(table(spark, x, y, w), loss, 1e-10, c=c)
    beta = np.append(model.coefficients.toArray(), model.intercept)
    assert np.linalg.norm(slope(x, y, w, beta, loss, c)) < 1e-4 * np.linalg.norm(slope(x, y, w, 0 * beta, loss, c))
    assert model.solution.steps < 60 and (loss == linear.LOGISTIC or 0 <= model.solution.gap + 1e-12 <= 1e-9)


@pytest.mark.parametrize("loss", [linear.LOGISTIC, linear.SQUARED_HINGE])
def test_blocks_and_dense_rows_give_the_same_model(spark, loss):
    x, y, w = data(80, 4)
    one = fit(table(spark, x, y, w), loss, 1e-7)
    many = fit(table(spark, x, y, w, sparse=False).repartition(4), loss, 1e-7, block_entries=120)
    assert many.coefficients.toArray() == pytest.approx(one.coefficients.toArray(), rel=1e-3, abs=1e-5)
    assert many.solution.aggregates < 200


def test_vectors_are_scored_in_small_batches(spark):
    """A batch is in memory as a whole, several times: 10,000 vectors of n-grams were more than an executor has."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    x, y, w = data(50, 4)
    df = table(spark, x, y, w)
    assert fit(df, linear.LOGISTIC, 1e-4).transform(df).count() == 50
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_rows_stay_in_files_and_products_know_the_curvature(spark, monkeypatch):
    """No table of rows is kept by the executors, and a product at a known point takes one pass."""
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    x, y, w = data(200, 5)
    monkeypatch.setattr(linear, "PIECE", 64)
    many = fit(table(spark, x, y, w), linear.LOGISTIC, 1e-8, block_entries=150)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
    monkeypatch.undo()
    assert many.coefficients.toArray() == pytest.approx(fit(table(spark, x, y, w), linear.LOGISTIC, 1e-8).coefficients.toArray(), rel=1e-4, abs=1e-6)


def test_gap_is_what_the_svm_stops_at(spark):
    x, y, w = data(400, 12)
    found = fit(table(spark, x, y, w), linear.SQUARED_HINGE, 1e-4).solution
    assert 0 <= found.gap <= 1e-4
    best = fit(table(spark, x, y, w), linear.SQUARED_HINGE, 1e-10).solution.objective
    assert best <= found.objective <= best * (1 + 1.1e-4)


def test_one_class_no_entries_and_no_rows(spark):
    df = table(spark, np.zeros((10, 3)), np.ones(10), np.ones(10))
    for loss in (linear.LOGISTIC, linear.SQUARED_HINGE):
        model = fit(df, loss, 1e-4)
        assert model.intercept > 0 and {r.prediction for r in model.transform(df).collect()} == {1.0}
        with pytest.raises(ValueError):
            fit(df.where("label = 0"), loss, 1e-4)


def sequential(rows):
    out = []
    for score in sorted({s for s, _ in rows}):
        labels = [y for s, y in rows if s == score]
        out.append([[score], sum(labels), len(labels)])
        while len(out) > 1 and out[-2][1] / out[-2][2] >= out[-1][1] / out[-1][2]:
            last = out.pop()
            out[-1] = [out[-1][0] + last[0], out[-1][1] + last[1], out[-1][2] + last[2]]
    return [(p[0][0], p[0][-1], p[1], p[2]) for p in out]


@pytest.mark.parametrize("bucket_rows", [200_000, 20])
@pytest.mark.parametrize("kind", ["noisy", "falling", "rising"])
def test_pools_equal_sequential_pooling(spark, bucket_rows, kind):
    rng = np.random.default_rng(4)
    scores = np.round(rng.normal(size=400), 2).tolist()
    labels = {"noisy": [int(rng.random() < 1 / (1 + np.exp(-2 * s))) for s in scores], "falling": [int(s < 0) for s in scores], "rising": [int(s > 0) for s in scores]}[kind]
    df = spark.createDataFrame([(s, y) for s, y in zip(scores, labels)] + [(None, 1), (1.0, None)], "margin double, label int")
    got = [tuple(r) for r in isotonic.pools(df, "margin", "label", bucket_rows).orderBy("low").collect()]
    assert got == [tuple(map(float, p)) for p in sequential(list(zip(scores, labels)))]


def test_isotonic_predictions(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 1), (2.0, 0), (4.0, 1)], "margin double, label int")
    model = isotonic.IsotonicModel(df, "margin", "label")
    asked = spark.createDataFrame([(x,) for x in (-5.0, 0.5, 1.5, 3.0, 9.0)], "margin double")
    assert [r.prediction for r in model.transform(asked).orderBy("margin").collect()] == pytest.approx([0, .25, .5, .75, 1])

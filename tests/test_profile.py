import pytest
from pyspark.sql import functions as F

from stylograin.operators import joins, profile
from stylograin.sources import normalise, sinks


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert profile.value_shares(df, "k").agg(F.sum("share")).first()[0] == pytest.approx(1)


def test_describe_without_group(spark):
    row = profile.describe(spark.createDataFrame([(1,), (2,), (4,)], "v int"), "v").first()
    assert (row.n, row.min, row.max, row.q25, row.q50, row.q75) == (3, 1, 4, 1.5, 2.0, 3.0)


def test_duplicates_and_leaks(spark):
    left = spark.createDataFrame([("x",), ("y",), ("x",)], "t string")
    right = spark.createDataFrame([("x",)] * 5 + [("z",)], "t string")
    assert profile.duplicate_count(left, "t").first().n_duplicates == 1
    assert joins.leaked_rows(right, left, "t").first().n_leaked == 5


def test_histogram_of_constant(spark):
    rows = profile.density_histogram(spark.createDataFrame([(5.0,)] * 4, "v double"), "v", 4).collect()
    assert sum(r.n for r in rows) == 4 and sum(r.density * 0.25 for r in rows) == pytest.approx(1)


def test_box_without_group(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "v double")
    row = profile.box_summary(df, "v").first()
    assert (row.q50, row.whisker_low, row.whisker_high, row.n_outliers) == (3.0, 1.0, 4.0, 1)


def test_constant_column_stays_unscaled(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double")
    rows = profile.standardised(df, ["a", "b"]).orderBy("a").collect()
    assert [(r.a, r.b) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]


def test_aliases(spark):
    df = spark.createDataFrame([("x", "1")], "` Snippet ` string, IS_AI string")
    out = normalise.normalised_columns(df)
    assert out.columns == ["code", "label"] and out.first().label == 1
    with pytest.raises(KeyError):
        normalise.normalised_columns(spark.createDataFrame([("x",)], "code string"))


def test_defaults(spark):
    row = normalise.with_defaults(spark.createDataFrame([("x",)], "code string"), "Python").first()
    assert (row.label, row.language) == (-1, "Python")


@pytest.mark.parametrize("preds, message", [([(1, 1)], "sample without a prediction: 2"), ([(1, 1), (2, 0), (3, 0)], "prediction without a sample: 3"),
                                            ([(1, 1), (2, 0), (2, 1)], "several predictions for: 2")])
def test_predictions_must_match_the_samples(spark, preds, message):
    samples = spark.createDataFrame([(1, 1), (2, 0)], "sample_id long, label int")
    with pytest.raises(Exception, match=message):
        joins.attach_predictions(samples, spark.createDataFrame(preds, "sample_id long, pred int")).collect()


def test_materialised_is_computed_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for variant in ("a", "a", "b"):
        assert sinks.materialised(spark, str(tmp_path), "train", variant, compute).count() == 3
    assert len(calls) == 2


def test_shared_folder_comes_from_the_session(spark):
    from stylograin.session import scratch_path
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

"""Null groups, unlisted values, unmatched keys and large cuts: nothing may get lost on the way."""

import pytest
from pyspark.sql import functions as F

from stylograin.functions.text import words
from stylograin.operators import drill, joins, metrics, ordering, profile, sampling, terms
from stylograin.sources import normalise, sinks

ROWS = [(1, "a", 1, 1, .9, 1.0), (2, "a", 0, 0, .1, 2.0), (3, "a", 1, 0, .4, 4.0), (4, None, 1, 1, .8, 8.0), (5, None, 0, 1, .7, 16.0)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "sample_id long, g string, y int, pred int, score double, x double")


def by_group(rows, column="g"):
    return {r[column]: r for r in rows.collect()}


def test_metrics_of_a_null_group(df):
    got = by_group(metrics.metric_rows(df, ["g"]))
    assert (got["a"].n_samples, got[None].n_samples) == (3, 2)
    assert got[None].accuracy == 0.5 and got[None].roc_auc == 1.0
    assert {r.g for r in metrics.group_breakdown(df, "g").collect()} == {"a", None}
    assert by_group(metrics.youden_threshold(df, ["g"]))[None].threshold == .8
    same = metrics.metric_rows(df, ["g"]).select("g", "accuracy")
    assert by_group(metrics.variant_comparison(same, same, "g", "accuracy"))[None].gain == 0


def test_profiles_of_a_null_group(df):
    assert by_group(profile.describe(df, "x", ["g"]))[None].q50 == 12.0
    shares = {(r.g, r.y): r.share for r in profile.value_shares(df, "y", ["g"]).collect()}
    assert shares == pytest.approx({("a", 1): 2 / 3, ("a", 0): 1 / 3, (None, 1): .5, (None, 0): .5})
    assert {r.g: r.s for r in profile.density_histogram(df, "x", 4, ["g"]).groupBy("g").agg(F.sum("n").alias("s")).collect()} == {"a": 3, None: 2}
    assert by_group(profile.box_summary(df, "x", ["g"]))[None].q50 == 12.0
    assert {(r.g, r.pct_a, r.pct_b) for r in joins.aligned_shares(df, df, "g").collect()} == {("a", 60.0, 60.0), (None, 40.0, 40.0)}


def test_samples_and_splits_of_a_null_group(df):
    assert sampling.stratified_split(df, "g").count() == 5 and sampling.folds(df, "g").count() == 5
    assert by_group(sampling.sample_per_group(df, 1, ["g"]).groupBy("g").count())[None]["count"] == 1
    got = {r.g: r["count"] for r in sampling.proportional_sample(df, 3, ["g"]).groupBy("g").count().collect()}
    assert got == {"a": 1, None: 1}
    assert sampling.proportional_sample(df, 1, ["g"]).count() == 1  # quotas of one each come to two


def test_class_means_of_a_null_group(spark):
    weights = spark.createDataFrame([(None, "t", 0, 1.0), (None, "t", 1, 3.0)], "g string, term string, label int, weight double")
    assert [r.difference for r in terms.class_means(weights, weights, by=["g"]).collect()] == [2.0]


def test_running_sums_over_many_buckets(spark):
    df = spark.range(2000).select((F.col("id") % 7).alias("g"), F.col("id").alias("v")).withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    got = ordering.prefix_sums(df, ["v"], {"one": F.lit(1)}, ["g"], buckets=50)
    assert got.where("g IS NULL").agg(F.max("one_upto")).first()[0] == 286
    assert got.where("one_upto <> floor(v / 7) + 1").isEmpty()


def test_crosstabs_keep_all_values(spark, df):
    df = df.withColumn("y", F.col("y").cast("string"))
    with pytest.raises(Exception, match="not listed"):
        profile.crosstab(df, "y", "g", ["a"]).collect()
    with pytest.raises(Exception, match="not listed"):
        drill.generator_language_matrix(df.selectExpr("g AS language", "y AS generator", "1 AS label", "1 AS correct"), ["a"]).collect()
    got = by_group(profile.crosstab(df, "y", "g"), "y")
    assert (got["1"].n_a, got["1"].n_null, got["0"].n_a, got["0"].n_null) == (2, 1, 1, 1)
    assert by_group(profile.crosstab_percent(df, "y", "g"), "y")["0"].pct_null == 50.0
    with pytest.raises(ValueError):
        profile.all_values(spark.range(20), "id", 10)


def test_predictions_must_match_by_key(spark):
    samples = spark.createDataFrame([(1, 1), (2, 0)], "sample_id long, label int")

    def attached(*rows):
        return joins.attach_predictions(samples, spark.createDataFrame(rows, "sample_id long, pred int")).collect()

    assert sorted((r.sample_id, r.correct) for r in attached((1, 1), (2, 1))) == [(1, 1), (2, 0)]
    for rows, fault in ((((1, 1), (3, 1)), "without a"), (((1, 1), (1, 1)), "without a prediction|several"), (((1, 1), (2, 1), (2, 0)), "several"),
                        (((1, 1),), "without a prediction")):
        with pytest.raises(Exception, match=fault):
            attached(*rows)


@pytest.mark.parametrize("k", [3, 5000])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_large_cuts_equal_brute_force(spark, k, by):
    df = spark.range(20_000).select("id", (F.col("id") % 3).alias("g"), F.pmod(F.hash("id"), F.lit(500)).alias("v"))
    rows = sorted(((r.g if by else 0), -r.v, r.id) for r in df.collect())
    seen, want = {}, set()
    for g, v, i in rows:
        seen[g] = seen.get(g, 0) + 1
        if seen[g] <= k:
            want.add((i, seen[g]))
    got = ordering.top_per_group(df, k, "v", "id", by)
    assert {(r.id, r["rank"]) for r in got.collect()} == want and got.columns == ["id", "g", "v", "rank"]


def test_vocabulary_cut_with_ties(spark):
    texts = ["é b c d", "b c d", "c d aaaaaaa aaaaaab", "zz zz", "c x"]
    df = spark.createDataFrame([(t,) for t in texts], "code string")
    rows = terms.term_totals(df, words(F.col("code"))).collect()
    order = [r.term for r in sorted(rows, key=lambda r: (-r.tf, r.term.encode()))]
    for n in range(1, len(order) + 2):
        assert {r.term for r in terms.vocabulary(df, words(F.col("code")), 1, n).collect()} == set(order[:n])
    assert {r.term: (r.tf, r.df) for r in rows}["zz"] == (2, 1)


def test_broadcast_only_what_keeps_to_its_bound(spark):
    def hinted(rows):
        return "hint" in joins.bounded(spark.range(20), rows)._jdf.queryExecution().logical().toString().lower()
    assert hinted(20) and not hinted(19) and not hinted(None)


def test_missing_columns_are_named_together(spark):
    with pytest.raises(KeyError, match="code, label"):
        normalise.normalised_columns(spark.createDataFrame([(1,)], "x int"))


def test_a_write_that_did_not_end_is_done_again(spark, tmp_path):
    path = tmp_path / "variant=v" / "split=s"
    path.mkdir(parents=True)
    (path / "part-00000.parquet").write_bytes(b"half a file")
    assert sinks.materialised(spark, str(tmp_path), "s", "v", lambda: spark.range(3)).count() == 3
    assert sinks.materialised(spark, str(tmp_path), "s", "v", lambda: spark.range(9)).count() == 3

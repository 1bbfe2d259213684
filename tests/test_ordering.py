import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylograin.operators import ordering as o
from stylograin.operators import sampling as s


def frame(spark, n=2000, seed=1):
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < 0.7 else rng.choice("abc"), 7 if rng.random() < 0.4 else rng.randint(0, 500))
            for i in range(n)]
    return spark.createDataFrame(rows, "sample_id long, g string, v int").repartition(5), rows


def order_key(i, seed=42):
    return hashlib.md5(f"{i}:{seed}".encode()).hexdigest() + str(i)


def test_prefix_sums(spark):
    df, rows = frame(spark)
    out = o.prefix_sums(df, ["sample_id"], {"v": F.col("v")}, buckets=16).orderBy("sample_id").collect()
    assert [r.v_upto for r in out] == list(np.cumsum([v for _, _, v in rows]))
    assert {r.v_all for r in out} == {sum(v for _, _, v in rows)}


def test_row_index_per_group(spark):
    df, rows = frame(spark)
    seen = {}
    got = {r.sample_id: (r.row_no, r.row_no_all) for r in o.row_index(df, ["sample_id"], ["g"]).collect()}
    sizes = {g: sum(x == g for _, x, _ in rows) for _, g, _ in rows}
    for i, g, _ in rows:
        seen[g] = seen.get(g, 0) + 1
        assert got[i] == (seen[g], sizes[g])


def test_quantiles_with_hot_value(spark):
    df, rows = frame(spark)
    shares = {"a": 0.0, "b": 0.25, "c": 0.333, "d": 0.9, "e": 1.0}
    for r in o.quantiles(df, "v", shares, ["g"]).collect():
        values = [v for _, g, v in rows if g == r.g]
        for name, share in shares.items():
            assert r[name] == pytest.approx(np.quantile(values, share))


def test_quantiles_ignore_nulls_and_negative_order(spark):
    df = spark.createDataFrame([(-1.5,), (None,), (0.0,), (3.0,)], "v double")
    assert o.quantiles(df, "v", {"m": 0.5}).first().m == 0.0


def test_simple_sample_is_exact(spark):
    df, rows = frame(spark)
    want = sorted(sorted((i for i, _, _ in rows), key=order_key)[:137])
    assert sorted(r.sample_id for r in s.simple_sample(df, 137).collect()) == want
    assert s.simple_sample(df, 10 ** 6).count() == len(rows)
    assert s.simple_sample(df, 0).count() == 0


def test_sample_does_not_depend_on_partitioning(spark):
    df, _ = frame(spark)
    a = {r.sample_id for r in s.sample_per_group(df.repartition(3), 20, ["g"]).collect()}
    assert a == {r.sample_id for r in s.sample_per_group(df.repartition(7, "v"), 20, ["g"]).collect()}
    assert len(a) == 80


def test_quota_example(spark):
    sizes = {"a": 700, "b": 290, "c": 9, "d": 1}
    rows = [(g, ) for g, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame([(i, g) for i, (g,) in enumerate(rows)], "sample_id long, g string")
    share = F.greatest(F.lit(1), F.floor(F.lit(100) * F.col("size") / F.lit(1000)))
    cuts = o.with_cutoffs(df, "sample_id", 42, {"_cut": F.least(F.col("size"), share)}, ["g"])
    taken = cuts.where(F.col("_key") <= F.col("_cut")).groupBy("g").count()
    assert {r.g: r["count"] for r in taken.collect()} == {"a": 70, "b": 29, "c": 1, "d": 1}
    assert s.proportional_sample(df, 100, ["g"]).count() == 100


def test_split_and_folds(spark):
    df, rows = frame(spark)
    sizes = {g: sum(x == g for _, x, _ in rows) for _, g, _ in rows}
    parts = s.stratified_split(df, "g").groupBy("g").agg(F.count_if(F.col("part") == "test").alias("n"))
    for r in parts.collect():
        assert abs(r.n - 0.2 * sizes[r.g]) <= 0.5
    for r in s.folds(df, "g").groupBy("g", "fold").count().collect():
        assert abs(r["count"] - sizes[r.g] / 3) <= 1


@pytest.mark.parametrize("k", [3, 2000])
def test_top_per_group(spark, k):
    df, rows = frame(spark, 3000)
    want = {g: sorted((i for i, x, _ in rows if x == g), reverse=True)[:k] for g in {x for _, x, _ in rows}}
    got = o.top_per_group(df, k, "sample_id", "g", ["g"]).collect()
    assert sorted((r.g, r["rank"], r.sample_id) for r in got) == sorted((g, n + 1, i) for g, ids in want.items() for n, i in enumerate(ids))
    whole = o.top_per_group(df, k, "sample_id", "g").collect()
    assert sorted((r["rank"], r.sample_id) for r in whole) == [(n + 1, i) for n, i in enumerate(sorted((i for i, _, _ in rows), reverse=True)[:k])]


def test_quantile_buckets_follow_the_order(spark):
    values = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1e300] + [((i * 7919) % 1000) / 10 for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r._bucket for r in o.with_quantile_bucket(df, "v", 16).orderBy("v").collect()]  # nulls first, NaN last
    assert got == sorted(got) and got[0] == 0 and len(set(got)) > 10
    assert {r._bucket for r in o.with_quantile_bucket(df.where("v IS NULL"), "v", 16).collect()} == {0}
    assert o.with_quantile_bucket(df.limit(0), "v", 16).collect() == []


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_top_with_hot_ties_nulls_and_nan(spark, by, descending):
    """A third of all rows share one value, the least and the largest are null and NaN, and a group may be null."""
    rng = random.Random(5)
    values = [None, float("nan"), float("-inf"), 7.0]
    rows = [(f"t{i:05d}", rng.choice([None, "hot", "hot", "b"]), rng.choice([*values, 7.0, round(rng.random() * 20, 1)])) for i in range(4000)]
    df = spark.createDataFrame(rows, "term string, g string, v double").repartition(5)

    def place(v):
        return (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v)

    for k in (1, 700, 2100, 10 ** 6):
        want = []
        for g in {g for _, g, _ in rows} if by else {0}:
            group = sorted(r for r in rows if not by or r[1] == g)
            group.sort(key=lambda r: place(r[2]), reverse=descending)  # stable: the least term stays first
            want += [(r[0], n + 1) for n, r in enumerate(group[:k])]
        got = o.top_per_group(df, k, "v", "term", by, descending=descending)
        assert got.columns == ["term", "g", "v", "rank"]
        assert sorted((r.term, r["rank"]) for r in got.collect()) == sorted(want)


def test_long_top_list_is_exact_and_in_shares(spark):
    n, k = 400_000, 100_000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.pmod(F.hash("id"), F.lit(1000))).alias("v"))
    rows = df.toPandas().sort_values(["v", "id"], ascending=[False, True]).head(k)
    got = o.top_per_group(df, k, "v", "id").toPandas().sort_values("rank")
    assert got["id"].tolist() == rows["id"].tolist() and got["rank"].tolist() == list(range(1, k + 1))
    placed = o.numbered_in_ranges(df, [F.desc("v"), F.asc("id")], [], n, "rank")
    assert placed.count() == n
    # The third of rows with one value is spread over many ranges.
    sizes = o._spread(df, [F.desc("v"), F.asc("id")], []).groupBy("_range").count().toPandas()["count"]
    assert len(sizes) == 8 and sizes.max() < n / 6


def test_top_of_nothing(spark):
    df = spark.createDataFrame([], "id long, v double")
    assert o.top_per_group(df, 5, "v", "id").collect() == [] and o.top_per_group(df, 5, "v", "id").columns == ["id", "v", "rank"]

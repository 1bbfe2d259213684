import math
import random

import pytest
from pyspark.sql import functions as F

from stylograin.operators import metrics as m

ROWS = [(1, 1, .9), (1, 1, .8), (0, 1, .8), (1, 0, .4), (0, 0, .4), (0, 0, .3), (0, 0, .2), (1, 0, .1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "y int, pred int, score double")


def test_worked_example(spark):
    row = m.metric_rows(frame(spark, ROWS)).first()
    want = dict(n_samples=8, n_machine=4, accuracy=0.625, binary_f1=0.571429, macro_f1=0.619048, macro_precision=0.633333,
                macro_recall=0.625, roc_auc=0.625, pr_auc=0.691667, mcc=0.258199, fnr=0.5)
    for name, value in want.items():
        assert row[name] == pytest.approx(value, abs=1e-6), name


def test_saved_confusion_matrix(spark):
    """Known counts give the published quality."""
    counts = spark.createDataFrame([(42374, 3196, 9931, 44499)], "tp long, fp long, fn long, tn long")
    c = m.count_metrics()
    row = counts.select(*[c[n].alias(n) for n in ("accuracy", "binary_f1", "fnr")]).first()
    assert (round(row.accuracy, 4), round(row.binary_f1, 4), round(row.fnr, 4)) == (0.8687, 0.8659, 0.1899)


def random_rows(seed, n=500, levels=40):
    rng = random.Random(seed)
    return [(rng.randint(0, 1), rng.randint(0, 1), rng.randint(0, levels) / levels) for _ in range(n)]


def brute_auc(rows):
    pos = [s for y, _, s in rows if y]
    neg = [s for y, _, s in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(rows):
    total = sum(y for y, _, _ in rows)
    out, seen = 0.0, 0.0
    for t in sorted({s for _, _, s in rows}, reverse=True):
        tp = sum(y for y, _, s in rows if s >= t)
        out += (tp / total - seen) * tp / sum(s >= t for _, _, s in rows)
        seen = tp / total
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_areas_against_brute_force(spark, seed):
    rows = random_rows(seed)
    row = m.metric_rows(frame(spark, rows)).first()
    assert row.roc_auc == pytest.approx(brute_auc(rows))
    assert row.pr_auc == pytest.approx(brute_ap(rows))


def test_area_of_negated_score(spark):
    rows = random_rows(3)
    up = m.metric_rows(frame(spark, rows)).first().roc_auc
    down = m.metric_rows(frame(spark, [(y, p, -s) for y, p, s in rows])).first().roc_auc
    assert up + down == pytest.approx(1)


def test_macro_f1_is_symmetric(spark):
    rows = random_rows(4)
    a = m.metric_rows(frame(spark, rows)).first().macro_f1
    b = m.metric_rows(frame(spark, [(1 - y, 1 - p, s) for y, p, s in rows])).first().macro_f1
    assert a == pytest.approx(b)


def test_hot_score_and_hot_group(spark):
    """A third of the rows share one score and most rows one group."""
    rows = random_rows(5, 300) + [(i % 2, 1, 0.5) for i in range(150)]
    df = frame(spark, rows).withColumn("grp", F.when(F.rand(1) < 0.9, "big").otherwise("small"))
    collected = [(r.grp, r.y, r.pred, r.score) for r in df.collect()]
    fixed = spark.createDataFrame(collected, "grp string, y int, pred int, score double")
    got = {r.grp: r for r in m.metric_rows(fixed, ["grp"]).collect()}
    for group in ("big", "small"):
        part = [(y, p, s) for g, y, p, s in collected if g == group]
        assert got[group].roc_auc == pytest.approx(brute_auc(part))
        assert got[group].pr_auc == pytest.approx(brute_ap(part))


def test_one_class_group_is_left_out(spark):
    rows = [("a", y, p, s) for y, p, s in ROWS] + [("b", 1, 1, .5), ("b", 1, 0, .2)]
    df = spark.createDataFrame(rows, "language string, y int, pred int, score double")
    out = m.group_breakdown(df, "language", ["a"]).collect()
    assert [(r.language, r.setting) for r in out] == [("a", "Seen")]


def test_rows_without_a_score_count_in_all_but_the_areas(spark):
    rows = ROWS + [(1, 0, None)]
    row, counts = m.metric_rows(frame(spark, rows)).first(), m.confusion_counts(frame(spark, rows)).first()
    assert (row.n_samples, row.n_machine) == (len(rows), counts.tp + counts.fn)
    assert row.accuracy == pytest.approx((counts.tp + counts.tn) / len(rows))
    assert row.roc_auc == m.metric_rows(frame(spark, ROWS)).first().roc_auc


def test_no_rows_have_no_metrics(spark):
    row = m.metric_rows(frame(spark, [])).first()
    assert row.n_samples == 0 and row.accuracy is None and row.fnr is None


def test_threshold_of_very_large_counts(spark, monkeypatch):
    big = 5 * 10 ** 9
    steps = spark.createDataFrame([(.9, 4 * 10 ** 9, 10, 4 * 10 ** 9, big), (.1, 4 * 10 ** 9, big, 4 * 10 ** 9, big)],
                                  "threshold double, tp_at bigint, fp_at bigint, pos_all bigint, neg_all bigint")
    monkeypatch.setattr(m, "score_steps", lambda *args: steps)
    assert m.youden_threshold(frame(spark, ROWS)).first().threshold == .9


def test_tables_by_list_refuse_what_is_not_listed(spark):
    df = spark.createDataFrame([(0, 0), (1, 2)], "y int, pred int")
    with pytest.raises(Exception, match="not listed"):
        m.confusion_table(df, [0, 1]).collect()
    assert sum(r.n for r in m.confusion_table(df).collect()) == 2 and m.confusion_table(df).count() == 9


def test_undefined_metrics_are_zero(spark):
    row = m.metric_rows(frame(spark, [(0, 0, .1), (0, 0, .2)])).first()
    assert row.binary_f1 == 0 and row.mcc == 0 and row.fnr == 1 and row.macro_f1 == 1 and row.roc_auc is None


def test_youden_takes_the_highest_threshold_on_ties(spark):
    rows = [(1, 1, .9), (0, 1, .8), (1, 1, .7), (0, 0, .1)]
    assert m.youden_threshold(frame(spark, rows)).first().threshold == .9


def test_best_f1_takes_the_lowest_threshold_on_ties(spark):
    rows = [(1, 1, .9), (0, 1, .8), (0, 1, .7), (1, 0, .6)]
    row = m.best_f1(frame(spark, rows)).first()
    curve = {r.threshold: r.f1 for r in m.f1_curve(frame(spark, rows)).collect()}
    best = max(curve.values())
    assert row.best_threshold == min(t for t, f in curve.items() if f == best)
    assert math.isclose(row.f1_at_fixed, 2 * 2 / (4 + 2))


def test_class_report_of_many_classes(spark):
    df = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (2, 1), (3, 3)], "y int, pred int")
    rows = {r["class"]: r for r in m.classification_report(df).collect()}
    assert rows["2"].precision == 0.5 and rows["2"].recall == 0.5 and rows["1"].f1 == 0
    assert rows["accuracy"].f1 == pytest.approx(0.6) and rows["macro avg"].support == 5


def test_markers(spark):
    a = spark.createDataFrame([("x", .5), ("y", .5), ("z", .5)], "g string, f double")
    b = spark.createDataFrame([("x", .6), ("y", .4), ("z", .52)], "g string, f double")
    marks = {r.g: r.mark for r in m.variant_comparison(a, b, "g", "f").collect()}
    assert marks == {"x": " ★", "y": " ↓", "z": ""}

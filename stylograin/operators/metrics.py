"""Evaluation metrics, threshold curves and comparison tables.

A prediction set has a true label, a predicted label and a score. All threshold
metrics start from one row per distinct score, so tied scores count as one step
and a hot score costs one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylograin.functions.labels import SEEN_LANGUAGES, setting
from stylograin.operators.ordering import join_groups, prefix_sums
from stylograin.operators.profile import all_values, listed
from stylograin.session import reused


def ratio(above: Column, below: Column) -> Column:
    """Quotient as double, 0 where it is undefined."""
    return F.coalesce(F.try_divide(above.cast("double"), below.cast("double")), F.lit(0.0))


def confusion_counts(df: DataFrame, by: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    """tp, fp, fn, tn as columns, from one aggregate."""
    t, p = F.col(y), F.col(pred)
    return df.groupBy(*by).agg(
        F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 0) & (p == 0)).alias("tn"))


def count_metrics() -> dict[str, Column]:
    """Every metric that follows from tp, fp, fn and tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    f1_pos, f1_neg = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fn + fp)
    prec_pos, prec_neg = ratio(tp, tp + fp), ratio(tn, tn + fn)
    rec_pos, rec_neg = ratio(tp, tp + fn), ratio(tn, tn + fp)
    # Classes that occur neither as truth nor as prediction are left out of macro means.
    has_pos, has_neg = tp + fp + fn > 0, tn + fp + fn > 0
    present = has_pos.cast("int") + has_neg.cast("int")

    def macro(a: Column, b: Column) -> Column:
        return ratio(F.when(has_pos, a).otherwise(0.0) + F.when(has_neg, b).otherwise(0.0), present)

    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "binary_f1": f1_pos,
        "macro_f1": macro(f1_pos, f1_neg),
        "macro_precision": macro(prec_pos, prec_neg),
        "macro_recall": macro(rec_pos, rec_neg),
        "mcc": ratio(tp * tn - fp * fn, spread),
        "fnr": 1 - rec_pos,
        "precision": prec_pos,
        "recall": rec_pos,
    }


def confusion_table(df: DataFrame, classes: Sequence[int] | None = None, y: str = "y", pred: str = "pred") -> DataFrame:
    """One row per (true, predicted) class, zeros included.

    A pair with a class outside the list (or null) is an error; without a list the classes
    are all that occur on either side.
    """
    spark = df.sparkSession
    pairs = df.select(F.col(y).cast("int").alias("y"), F.col(pred).cast("int").alias("pred"))
    if classes is None:
        classes = sorted({*all_values(pairs, "y"), *all_values(pairs, "pred")})
    counts = pairs.groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n"))
    counts = reused(counts.select(*[listed(F.col(c), classes).alias(c) for c in ("y", "pred")], "n"))
    lists = F.array(*[F.lit(c) for c in classes])
    grid = (spark.range(1).select(F.explode(lists).alias("y"))
            .select("y", F.explode(lists).alias("pred")))
    return grid.join(counts, ["y", "pred"], "left").select(
        "y", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_rows(df: DataFrame, by: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    """Per class: precision, recall, F1 and support, for any number of classes."""
    pairs = df.groupBy(*by, F.col(y).cast("int").alias("_y"), F.col(pred).cast("int").alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"))
    hit = F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0)
    sides = F.inline(F.array(
        F.struct(F.col("_y").alias("class"), F.col("_n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"), hit.cast("bigint").alias("hits")),
        F.struct(F.col("_p").alias("class"), F.lit(0).cast("bigint").alias("support"),
                 F.col("_n").alias("predicted"), F.lit(0).cast("bigint").alias("hits"))))
    sums = pairs.select(*by, sides).groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
        F.sum("hits").alias("hits"))
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    return sums.select(
        *by, "class", ratio(hits, predicted).alias("precision"), ratio(hits, support).alias("recall"),
        ratio(2 * hits, support + predicted).alias("f1"), "support", "hits")


def classification_report(df: DataFrame, names: Mapping[int, str] | None = None,
                          y: str = "y", pred: str = "pred") -> DataFrame:
    """Per-class rows, then accuracy, macro average and weighted average."""
    rows = class_rows(df, y=y, pred=pred)
    label = F.col("class").cast("string")
    for value, name in (names or {}).items():
        label = F.when(F.col("class") == value, name).otherwise(label)
    n = F.sum("support")
    share = F.sum("hits") / n
    averages = rows.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"), share.alias("precision"),
                     share.alias("recall"), share.alias("f1"), n.alias("support")),
            F.struct(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                     F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), n.alias("support")),
            F.struct(F.lit("weighted avg").alias("class"),
                     (F.sum(F.col("precision") * F.col("support")) / n).alias("precision"),
                     (F.sum(F.col("recall") * F.col("support")) / n).alias("recall"),
                     (F.sum(F.col("f1") * F.col("support")) / n).alias("f1"), n.alias("support")),
        ).alias("rows")).select(F.inline("rows"))
    return rows.select(label.alias("class"), "precision", "recall", "f1", "support").unionByName(averages)


def score_counts(df: DataFrame, by: Sequence[str] = (), y: str = "y", pred: str | None = None,
                 score: str = "score") -> DataFrame:
    """One row per distinct score with class counts; the rows without a score are one row with ``known`` 0.

    With ``pred`` there are the four outcomes as well.
    """
    t = F.col(y)
    outcomes = []
    if pred:
        p = F.col(pred)
        outcomes = [F.count_if((t == a) & (p == b)).alias(name)
                    for name, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))]
    return reused(df.groupBy(*by, F.col(score).cast("double").alias("threshold")).agg(
        F.count(score).alias("known"), F.count_if(t == 1).alias("pos"), F.count_if(t == 0).alias("neg"), *outcomes))


def score_steps(df: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """One row per distinct score with class counts, then counts at and above that score.

    Adds ``tp_at`` and ``fp_at`` (rows with at least this score), ``pos_all`` and ``neg_all``.
    Rows without a score are on no curve.
    """
    return steps_of(score_counts(df, by, y, None, score), by)


def steps_of(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    # Rows without a score go by their count: a null test on a computed score would be
    # pushed below the aggregate and compute the score twice.
    steps = counts.where(F.col("known") > 0).drop("known")
    sums = prefix_sums(steps, ["threshold"], {"pos": F.col("pos"), "neg": F.col("neg")}, by)
    return sums.withColumns({
        "tp_at": F.col("pos_all") - F.col("pos_upto") + F.col("pos"),
        "fp_at": F.col("neg_all") - F.col("neg_upto") + F.col("neg")})


def area_metrics() -> dict[str, Column]:
    """ROC-AUC (ties count half) and average precision, over the rows of ``score_steps``."""
    below = F.col("neg_upto") - F.col("neg") + F.col("neg") / 2.0
    wins = F.sum(F.col("pos") * below)
    pairs = F.first("pos_all").cast("double") * F.first("neg_all").cast("double")
    steps = F.sum(F.col("pos") * F.col("tp_at") / (F.col("tp_at") + F.col("fp_at")))
    return {"roc_auc": F.try_divide(wins, pairs),
            "pr_auc": F.try_divide(steps, F.first("pos_all").cast("double"))}


def metric_rows(df: DataFrame, by: Sequence[str] = (), y: str = "y", pred: str = "pred",
                score: str = "score") -> DataFrame:
    """The full metric row per group, from one scan of the predictions.

    Rows without a score count in all metrics but the two areas. A group without any pair
    of label and prediction has no metrics: they are null, and ``n_samples`` is 0.
    """
    by = list(by)
    counted = score_counts(df, by, y, pred, score)
    areas = area_metrics()
    sums = counted.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "tn")])
    under = steps_of(counted, by).groupBy(*by).agg(*[column.alias(name) for name, column in areas.items()])
    if by:
        sums = join_groups(sums, under, by, "left")
    else:
        # One row on either side.
        sums = sums.withColumn("_a", under.select(F.struct(*areas)).scalar()).select("*", "_a.*").drop("_a")
    counts = count_metrics()
    names = ["accuracy", "binary_f1", "macro_f1", "macro_precision", "macro_recall", "roc_auc",
             "pr_auc", "mcc", "fnr"]
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    positives = F.col("tp") + F.col("fn")
    return sums.select(*by, n.alias("n_samples"), positives.alias("n_machine"),
                       *[F.when(n > 0, F.col(m) if m in areas else counts[m]).alias(m) for m in names])


def group_breakdown(df: DataFrame, group: str, seen: Sequence = SEEN_LANGUAGES, y: str = "y",
                    pred: str = "pred", score: str = "score") -> DataFrame:
    """Per group that holds both classes: size, machine share, macro F1, PR-AUC, FNR, setting."""
    rows = metric_rows(df, [group], y, pred, score)
    both = (F.col("n_machine") > 0) & (F.col("n_machine") < F.col("n_samples"))
    return rows.where(both).select(
        group, setting(F.col(group), seen).alias("setting"), "n_samples",
        (F.col("n_machine") / F.col("n_samples")).alias("pct_machine"), "macro_f1", "pr_auc",
        "fnr").orderBy(group)


def accuracy_by(df: DataFrame, group: str, y: str = "y", pred: str = "pred") -> DataFrame:
    """Accuracy and binary F1 per group, without a guard."""
    metrics = count_metrics()
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return confusion_counts(df, [group], y, pred).select(
        group, n.alias("n"), metrics["accuracy"].alias("accuracy"), metrics["binary_f1"].alias("f1"))


def roc_curve(df: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score."""
    return score_steps(df, by, y, score).select(
        *by, "threshold", ratio(F.col("fp_at"), F.col("neg_all")).alias("fpr"),
        ratio(F.col("tp_at"), F.col("pos_all")).alias("tpr"))


def pr_curve(df: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """(threshold, precision, recall) for every distinct score, and the prevalence."""
    return score_steps(df, by, y, score).select(
        *by, "threshold", ratio(F.col("tp_at"), F.col("tp_at") + F.col("fp_at")).alias("precision"),
        ratio(F.col("tp_at"), F.col("pos_all")).alias("recall"),
        ratio(F.col("pos_all"), F.col("pos_all") + F.col("neg_all")).alias("prevalence"))


def youden_threshold(df: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """Threshold of the largest TPR - FPR, the highest one on ties.

    The difference is compared as a whole number, so ties do not hang on rounding.
    """
    steps = score_steps(df, by, y, score)
    tp, fp, pos, neg = (F.col(c).cast("decimal(19,0)") for c in ("tp_at", "fp_at", "pos_all", "neg_all"))
    gain = (tp * neg).cast("decimal(38,0)") - (fp * pos).cast("decimal(38,0)")
    best = F.max(F.struct(gain.alias("gain"), F.col("threshold"), F.col("tp_at"), F.col("fp_at"),
                          F.col("pos_all"), F.col("neg_all")))
    return steps.groupBy(*by).agg(best.alias("b")).select(
        *by, F.col("b.threshold").alias("threshold"),
        ratio(F.col("b.tp_at"), F.col("b.pos_all")).alias("tpr"),
        ratio(F.col("b.fp_at"), F.col("b.neg_all")).alias("fpr"))


def f1_curve(df: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """F1 at every threshold; 1e-9 in the denominator keeps it defined."""
    curve = pr_curve(df, by, y, score)
    p, r = F.col("precision"), F.col("recall")
    return curve.select(*by, "threshold", (2 * p * r / (p + r + F.lit(1e-9))).alias("f1"))


def best_f1(df: DataFrame, fixed: float = 0.5, by: Sequence[str] = (), y: str = "y",
            score: str = "score") -> DataFrame:
    """Best F1 and its threshold (the lowest on ties), and F1 when cutting at ``fixed``."""
    steps = score_steps(df, by, y, score)
    p = ratio(F.col("tp_at"), F.col("tp_at") + F.col("fp_at"))
    r = ratio(F.col("tp_at"), F.col("pos_all"))
    f1 = 2 * p * r / (p + r + F.lit(1e-9))
    best = F.max(F.struct(f1.alias("f1"), (-F.col("threshold")).alias("t")))
    above = F.col("threshold") >= fixed
    tp, fp = F.sum(F.when(above, F.col("pos")).otherwise(0)), F.sum(F.when(above, F.col("neg")).otherwise(0))
    at_fixed = ratio(2.0 * tp, tp + fp + F.first("pos_all"))
    return steps.groupBy(*by).agg(best.alias("b"), at_fixed.alias("f1_at_fixed")).select(
        *by, F.col("b.f1").alias("best_f1"), (-F.col("b.t")).alias("best_threshold"), "f1_at_fixed")


def best_row(history: DataFrame, metric: str, order: str) -> DataFrame:
    """Row of the largest metric, the first one in ``order`` on ties."""
    return history.orderBy(F.desc(metric), order).limit(1)


def comparison_table(results: DataFrame, metric: str, order: str) -> DataFrame:
    """Gain over the first row and a mark for the best; a results table is a few rows."""
    every = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.max(metric).over(every)
    return results.withColumns({
        "gain": F.col(metric) - F.first(metric).over(every),
        "mark": F.when(F.col(metric) == best, " ★ BEST").otherwise("")})


def shift_drop(results: DataFrame, model: str, split: str, metric: str, known: str = "val",
               shifted: str = "ood") -> DataFrame:
    """Metric on known and shifted data side by side, and what is lost."""
    a = F.max(F.when(F.col(split) == known, F.col(metric)))
    b = F.max(F.when(F.col(split) == shifted, F.col(metric)))
    return results.groupBy(model).agg(a.alias(f"{known}_{metric}"), b.alias(f"{shifted}_{metric}"),
                                      (a - b).alias("drop"))


def variant_comparison(a: DataFrame, b: DataFrame, group: str, metric: str,
                       up: float = 0.05, down: float = -0.02) -> DataFrame:
    """Metric of two variants per group, gain and marker."""
    joined = join_groups(a.select(group, F.col(metric).alias("value_a")),
                         b.select(group, F.col(metric).alias("value_b")), [group])
    gain = F.col("value_b") - F.col("value_a")
    mark = F.when(gain > up, " ★").when(gain < down, " ↓").otherwise("")
    return joined.select(group, "value_a", "value_b", gain.alias("gain"), mark.alias("mark"))


def fusion_verdict(gain: Column, margin: float = 0.005) -> Column:
    return (F.when(gain > margin, "positive").when(F.abs(gain) <= margin, "null")
            .otherwise("negative"))

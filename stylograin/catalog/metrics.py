"""Evaluation metrics over events as predictions and vectors as logits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylograin.catalog.registry import query
from stylograin.catalog.tables import CUT, GROUPS_SEEN, JUDGED_SQL, SCORED_SQL, Tables
from stylograin.functions.arrays import argmax, cross_entropy
from stylograin.operators import metrics as m

CUTS = {"1 low cut": 20.0, "2 middle cut": CUT, "3 high cut": 50.0}

# Per class and group: hits, support, predicted; then macro means over the classes present.
CONF_SQL = """conf AS (SELECT {by} sum(y * pred)::DOUBLE AS tp, sum((1 - y) * pred)::DOUBLE AS fp,
  sum(y * (1 - pred))::DOUBLE AS fn, sum((1 - y) * (1 - pred))::DOUBLE AS tn, count(*) AS n FROM {src} {group})"""

ACC = "(tp + tn) / (tp + fp + fn + tn)"
F1P, F1N = ("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)", "coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0)")
PP, PN = "coalesce(tp / nullif(tp + fp, 0), 0)", "coalesce(tn / nullif(tn + fn, 0), 0)"
RP, RN = "coalesce(tp / nullif(tp + fn, 0), 0)", "coalesce(tn / nullif(tn + fp, 0), 0)"
MCC = "coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0)"


def macro(a: str, b: str) -> str:
    pos, neg = "(tp + fp + fn > 0)::INTEGER", "(tn + fp + fn > 0)::INTEGER"
    return f"({a} * {pos} + {b} * {neg}) / ({pos} + {neg})"


COUNT_SQL = {
    "accuracy": ACC, "binary_f1": F1P, "macro_f1": macro(F1P, F1N), "macro_precision": macro(PP, PN),
    "macro_recall": macro(RP, RN), "mcc": MCC, "fnr": f"1 - {RP}", "precision": PP, "recall": RP,
}


def conf_sql(by: str = "", src: str = "scored") -> str:
    return CONF_SQL.format(by=by + "," if by else "", src=src, group=f"GROUP BY {by}" if by else "")


def one_metric_sql(name: str) -> str:
    return f"WITH {SCORED_SQL}, {conf_sql()} SELECT round({COUNT_SQL[name]}, 6) AS {name} FROM conf"


def curve_sql(by: str = "") -> str:
    """Counts at and above every distinct score, by plain windows."""
    key = by + "," if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""steps AS (SELECT {key} score AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM scored
      GROUP BY {key} score),
    curve AS (SELECT {key} threshold, pos, neg, sum(pos) OVER d AS tp_at, sum(neg) OVER d AS fp_at,
      sum(pos) OVER (a) AS pos_all, sum(neg) OVER (a) AS neg_all FROM steps
      WINDOW d AS ({part} ORDER BY threshold DESC), a AS ({part})),
    areas AS (SELECT {key} sum(neg * (tp_at - pos / 2.0)) / max(pos_all * neg_all) AS roc_auc,
      sum(pos * tp_at / (tp_at + fp_at)) / max(pos_all) AS pr_auc FROM curve {f'GROUP BY {by}' if by else ''})"""


def full_row_sql(by: str = "") -> str:
    names = ["accuracy", "binary_f1", "macro_f1", "macro_precision", "macro_recall", "mcc", "fnr"]
    counts = ", ".join(f"round({COUNT_SQL[x]}, 6) AS {x}" for x in names)
    join = f"conf JOIN areas USING ({by})" if by else "conf, areas"
    return f"""WITH {SCORED_SQL}, {conf_sql(by)}, {curve_sql(by)} SELECT {by + ',' if by else ''}
      n AS n_samples, (tp + fn)::BIGINT AS n_machine, {counts}, round(roc_auc, 6) AS roc_auc,
      round(pr_auc, 6) AS pr_auc FROM {join}"""


def count_metric(t: Tables, name: str) -> DataFrame:
    return m.confusion_counts(t.scored()).select(m.count_metrics()[name].alias(name))


def class_scores(t: Tables) -> DataFrame:
    """Vectors as logits of ten classes."""
    return t.table("embeddings").select(
        "vec_id", F.col("label").alias("y"), (argmax(F.col("embedding")) % 10).alias("pred"))


CLASS_SQL = """cls AS (SELECT vec_id, label AS y,
  CAST((list_position(embedding, list_max(embedding)) - 1) % 10 AS INTEGER) AS pred FROM embeddings)"""


def history(t: Tables) -> DataFrame:
    """Metric rows of the groups, read as the epochs of a training run."""
    rows = m.confusion_counts(t.scored(), ["grp"])
    return rows.select(F.col("grp").alias("epoch"), m.count_metrics()["macro_f1"].alias("macro_f1"))


def by_cut(t: Tables) -> DataFrame:
    """Macro F1 of three cuts of one score, as three models; one scan serves all."""
    cuts = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(c).alias("cut")) for n, c in CUTS.items()])
    rows = t.scored().select("y", "score", "grp", F.inline(cuts)).withColumn(
        "pred", (F.col("score") >= F.col("cut")).cast("int"))
    return rows


CUTS_SQL = "cuts AS (SELECT * FROM (VALUES {}) v(model, cut)), many AS (SELECT model, grp, y, CAST(score >= cut AS INTEGER) AS pred FROM scored, cuts)".format(
    ", ".join(f"('{n}', {c}::DOUBLE)" for n, c in CUTS.items()))


@query("m01_confusion_matrix", f"""WITH {SCORED_SQL}, g AS (SELECT a.v AS y, b.v AS pred FROM
  (VALUES (0), (1)) a(v), (VALUES (0), (1)) b(v)) SELECT g.y, g.pred, count(s.y) AS n FROM g
  LEFT JOIN scored s ON s.y = g.y AND s.pred = g.pred GROUP BY 1, 2""")
def confusion_matrix(t: Tables):
    return m.confusion_table(t.scored(), [0, 1])


@query("m01_confusion_matrix_ten_classes", f"""WITH {CLASS_SQL}, g AS (SELECT a.v::INTEGER AS y, b.v::INTEGER AS pred
  FROM range(10) a(v), range(10) b(v)) SELECT g.y, g.pred, count(c.y) AS n FROM g
  LEFT JOIN cls c ON c.y = g.y AND c.pred = g.pred GROUP BY 1, 2""")
def confusion_matrix_ten(t: Tables):
    return m.confusion_table(class_scores(t), range(10))


@query("m02_accuracy", one_metric_sql("accuracy"))
def accuracy(t: Tables):
    return count_metric(t, "accuracy")


@query("m03_binary_f1", one_metric_sql("binary_f1"))
def binary_f1(t: Tables):
    return count_metric(t, "binary_f1")


@query("m04_macro_f1", one_metric_sql("macro_f1"))
def macro_f1(t: Tables):
    return count_metric(t, "macro_f1")


@query("m04_macro_f1_ten_classes", f"""WITH {CLASS_SQL}, c AS (SELECT k.v AS k,
  count(*) FILTER (y = k.v AND pred = k.v) AS hit, count(*) FILTER (y = k.v) AS sup,
  count(*) FILTER (pred = k.v) AS pre FROM cls, range(10) k(v) GROUP BY 1)
  SELECT round(avg(2 * hit / (sup + pre)), 6) AS macro_f1 FROM c WHERE sup + pre > 0""")
def macro_f1_ten(t: Tables):
    return m.class_rows(class_scores(t)).agg(F.avg("f1").alias("macro_f1"))


@query("m05_macro_precision", one_metric_sql("macro_precision"))
def macro_precision(t: Tables):
    return count_metric(t, "macro_precision")


@query("m06_macro_recall", one_metric_sql("macro_recall"))
def macro_recall(t: Tables):
    return count_metric(t, "macro_recall")


@query("m07_roc_auc", f"WITH {SCORED_SQL}, {curve_sql()} SELECT round(roc_auc, 6) AS roc_auc FROM areas")
def roc_auc(t: Tables):
    return m.score_steps(t.scored()).agg(m.area_metrics()["roc_auc"].alias("roc_auc"))


@query("m08_pr_auc", f"WITH {SCORED_SQL}, {curve_sql()} SELECT round(pr_auc, 6) AS pr_auc FROM areas")
def pr_auc(t: Tables):
    return m.score_steps(t.scored()).agg(m.area_metrics()["pr_auc"].alias("pr_auc"))


@query("m09_mcc", one_metric_sql("mcc"))
def mcc(t: Tables):
    return count_metric(t, "mcc")


@query("m10_fnr", one_metric_sql("fnr"))
def fnr(t: Tables):
    return count_metric(t, "fnr")


@query("m11_full_metric_row", full_row_sql())
def full_metric_row(t: Tables):
    return m.metric_rows(t.scored())


@query("m11_full_metric_row_per_group", full_row_sql("grp"))
def full_metric_row_per_group(t: Tables):
    return m.metric_rows(t.scored(), ["grp"])


REPORT_SQL = """per AS (SELECT k, coalesce(hit / nullif(pre, 0), 0) AS precision, coalesce(hit / nullif(sup, 0), 0) AS recall,
    coalesce(2 * hit / nullif(sup + pre, 0), 0) AS f1, sup AS support, hit FROM c WHERE sup + pre > 0)
  SELECT {name} AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per
  UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6),
    round(sum(hit) / sum(support), 6), sum(support)::BIGINT FROM per
  UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM per
  UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
    round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM per"""


@query("m12_classification_report", f"""WITH {SCORED_SQL}, c AS (SELECT k.v AS k,
  count(*) FILTER (y = k.v AND pred = k.v) AS hit, count(*) FILTER (y = k.v) AS sup,
  count(*) FILTER (pred = k.v) AS pre FROM scored, range(2) k(v) GROUP BY 1),
  """ + REPORT_SQL.format(name="CASE k WHEN 0 THEN 'Human' ELSE 'Machine' END"))
def classification_report(t: Tables):
    return m.classification_report(t.scored(), {0: "Human", 1: "Machine"})


@query("m12_classification_report_ten_classes", f"""WITH {CLASS_SQL}, c AS (SELECT k.v AS k,
  count(*) FILTER (y = k.v AND pred = k.v) AS hit, count(*) FILTER (y = k.v) AS sup,
  count(*) FILTER (pred = k.v) AS pre FROM cls, range(10) k(v) GROUP BY 1),
  """ + REPORT_SQL.format(name="k::VARCHAR"))
def classification_report_ten(t: Tables):
    return m.classification_report(class_scores(t))


@query("m13_group_breakdown", f"""WITH {SCORED_SQL}, {conf_sql('grp')}, {curve_sql('grp')}
  SELECT grp, CASE WHEN grp IN (0, 1, 2, 3) THEN 'Seen' ELSE 'Unseen' END AS setting, n AS n_samples,
  round((tp + fn) / n, 6) AS pct_machine, round({COUNT_SQL['macro_f1']}, 6) AS macro_f1,
  round(pr_auc, 6) AS pr_auc, round({COUNT_SQL['fnr']}, 6) AS fnr FROM conf JOIN areas USING (grp)
  WHERE tp + fn > 0 AND tn + fp > 0""")
def group_breakdown(t: Tables):
    return m.group_breakdown(t.scored(), "grp", GROUPS_SEEN)


@query("m13_language_breakdown", f"""WITH {JUDGED_SQL}, scored AS (SELECT language, label AS y, pred, words AS score FROM judged),
  {conf_sql('language')}, {curve_sql('language')}
  SELECT language, CASE WHEN language IN ('en', 'fr') THEN 'Seen' ELSE 'Unseen' END AS setting, n AS n_samples,
  round((tp + fn) / n, 6) AS pct_machine, round({COUNT_SQL['macro_f1']}, 6) AS macro_f1,
  round(pr_auc, 6) AS pr_auc, round({COUNT_SQL['fnr']}, 6) AS fnr FROM conf JOIN areas USING (language)
  WHERE tp + fn > 0 AND tn + fp > 0""")
def language_breakdown(t: Tables):
    return m.group_breakdown(t.judged(), "language", ["en", "fr"], y="label", score="words")


@query("m14_accuracy_by_group", f"""WITH {SCORED_SQL}, {conf_sql('grp')} SELECT grp, n,
  round({ACC}, 6) AS accuracy, round({F1P}, 6) AS f1 FROM conf""")
def accuracy_by_group(t: Tables):
    return m.accuracy_by(t.scored(), "grp")


@query("m15_roc_curve", f"""WITH {SCORED_SQL}, {curve_sql()} SELECT threshold, round(fp_at / neg_all, 6) AS fpr,
  round(tp_at / pos_all, 6) AS tpr FROM curve""")
def roc_curve(t: Tables):
    return m.roc_curve(t.scored())


@query("m16_pr_curve", f"""WITH {SCORED_SQL}, {curve_sql()} SELECT threshold, round(tp_at / (tp_at + fp_at), 6) AS precision,
  round(tp_at / pos_all, 6) AS recall, round(pos_all / (pos_all + neg_all), 6) AS prevalence FROM curve""")
def pr_curve(t: Tables):
    return m.pr_curve(t.scored())


@query("m17_youden_threshold", f"""WITH {SCORED_SQL}, {curve_sql()} SELECT threshold,
  round(tp_at / pos_all, 6) AS tpr, round(fp_at / neg_all, 6) AS fpr FROM curve
  ORDER BY tp_at * neg_all - fp_at * pos_all DESC, threshold DESC LIMIT 1""")
def youden_threshold(t: Tables):
    return m.youden_threshold(t.scored())


@query("m17_youden_threshold_per_group", f"""WITH {SCORED_SQL}, {curve_sql('grp')} SELECT grp, threshold,
  round(tp_at / pos_all, 6) AS tpr, round(fp_at / neg_all, 6) AS fpr FROM curve
  QUALIFY row_number() OVER (PARTITION BY grp ORDER BY tp_at * neg_all - fp_at * pos_all DESC, threshold DESC) = 1""")
def youden_threshold_per_group(t: Tables):
    return m.youden_threshold(t.scored(), ["grp"])


F1_AT = """SELECT threshold, pos, neg, pos_all, 2 * p * r / (p + r + 1e-9) AS f1 FROM
  (SELECT *, tp_at / (tp_at + fp_at) AS p, tp_at / pos_all AS r FROM curve)"""


@query("m18_f1_curve", f"""WITH {SCORED_SQL}, {curve_sql()} SELECT threshold, round(f1, 6) AS f1 FROM ({F1_AT})""")
def f1_curve(t: Tables):
    return m.f1_curve(t.scored())


@query("m18_best_f1", f"""WITH {SCORED_SQL}, {curve_sql()}, f AS ({F1_AT}),
  h AS (SELECT round(2 * sum(pos) / (sum(pos) + sum(neg) + max(pos_all)), 6) AS f1_at_fixed FROM f WHERE threshold >= 50)
  SELECT round(f1, 6) AS best_f1, threshold AS best_threshold, f1_at_fixed FROM f, h
  ORDER BY f1 DESC, threshold LIMIT 1""")
def best_f1(t: Tables):
    return m.best_f1(t.scored(), fixed=50.0)


HISTORY_SQL = f"""{SCORED_SQL}, {conf_sql('grp')}, history AS (SELECT grp AS epoch,
  {COUNT_SQL['macro_f1']} AS macro_f1 FROM conf)"""


@query("m19_best_epoch", f"""WITH {HISTORY_SQL} SELECT epoch, round(macro_f1, 6) AS macro_f1 FROM history
  ORDER BY history.macro_f1 DESC, epoch LIMIT 1""")
def best_epoch(t: Tables):
    return m.best_row(history(t), "macro_f1", "epoch")


@query("m20_comparison_table", f"""WITH {SCORED_SQL}, {CUTS_SQL}, {conf_sql('model', 'many')},
  r AS (SELECT model, {COUNT_SQL['macro_f1']} AS f FROM conf)
  SELECT model, round(f, 6) AS macro_f1, round(f - first_value(f) OVER (ORDER BY model), 6) AS gain,
  CASE WHEN f = max(f) OVER () THEN ' ★ BEST' ELSE '' END AS mark FROM r""")
def comparison_table(t: Tables):
    results = m.confusion_counts(by_cut(t), ["model"]).select("model", m.count_metrics()["macro_f1"].alias("macro_f1"))
    return m.comparison_table(results, "macro_f1", "model")


@query("m21_shift_drop", f"""WITH {JUDGED_SQL}, many AS (SELECT k.model, split, label AS y,
    CASE k.model WHEN 'rule' THEN pred ELSE CAST(words >= 300 AS INTEGER) END AS pred
    FROM judged, (VALUES ('rule'), ('length')) k(model)), {conf_sql('model, split', 'many')},
  r AS (SELECT model, max({COUNT_SQL['macro_f1']}) FILTER (split = 'val') AS v,
    max({COUNT_SQL['macro_f1']}) FILTER (split = 'ood') AS o FROM conf GROUP BY 1)
  SELECT model, round(v, 6) AS val_macro_f1, round(o, 6) AS ood_macro_f1, round(v - o, 6) AS "drop" FROM r""")
def shift_drop(t: Tables):
    models = F.array(
        F.struct(F.lit("rule").alias("model"), F.col("pred")),
        F.struct(F.lit("length").alias("model"), (F.col("words") >= 300).cast("int").alias("pred")))
    rows = t.judged().select("split", F.col("label").alias("y"), F.inline(models))
    results = m.confusion_counts(rows, ["model", "split"]).select(
        "model", "split", m.count_metrics()["macro_f1"].alias("macro_f1"))
    return m.shift_drop(results, "model", "split", "macro_f1")


@query("m22_fusion_verdict", f"""WITH {SCORED_SQL}, {CUTS_SQL}, {conf_sql('model, grp', 'many')},
  r AS (SELECT model, grp, {COUNT_SQL['macro_f1']} AS f FROM conf),
  g AS (SELECT a.grp, b.f - a.f AS gain FROM r a JOIN r b ON a.grp = b.grp
    WHERE a.model = '1 low cut' AND b.model = '2 middle cut')
  SELECT grp, round(gain, 6) AS gain, CASE WHEN gain > 0.005 THEN 'positive' WHEN abs(gain) <= 0.005 THEN 'null'
    ELSE 'negative' END AS verdict FROM g""")
def fusion_verdict(t: Tables):
    rows = m.confusion_counts(by_cut(t), ["model", "grp"]).select(
        "model", "grp", m.count_metrics()["macro_f1"].alias("f"))
    gain = F.max(F.when(F.col("model") == "2 middle cut", F.col("f"))) - F.max(
        F.when(F.col("model") == "1 low cut", F.col("f")))
    return rows.groupBy("grp").agg(gain.alias("gain")).withColumn("verdict", m.fusion_verdict(F.col("gain")))


@query("m23_cross_entropy", """WITH e AS (SELECT label, embedding::DOUBLE[] AS v, list_max(embedding)::DOUBLE AS top FROM embeddings)
  SELECT round(avg(ln(list_sum(list_transform(v, lambda x: exp(x - top)))) - (v[label + 1] - top)), 6) AS loss FROM e""")
def mean_cross_entropy(t: Tables):
    return t.table("embeddings").agg(F.avg(cross_entropy(F.col("embedding"), F.col("label"))).alias("loss"))


@query("m24_precision_recall", f"""WITH {SCORED_SQL}, {conf_sql('grp')} SELECT grp, round({PP}, 6) AS precision,
  round({RP}, 6) AS recall FROM conf""")
def precision_recall(t: Tables):
    metrics = m.count_metrics()
    return m.confusion_counts(t.scored(), ["grp"]).select(
        "grp", metrics["precision"].alias("precision"), metrics["recall"].alias("recall"))

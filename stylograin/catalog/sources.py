"""Scans, column normalisation, prediction attach and sinks.

Sinks write to the shared folder of the session and the query returns what is read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stylograin.catalog.metrics import COUNT_SQL, CUTS_SQL, HISTORY_SQL, conf_sql, by_cut, history
from stylograin.catalog.registry import query
from stylograin.catalog.tables import (DOCS_SQL, MARKERS, NODES_SQL, RULE_SQL, SAMPLES_SQL, SCORED_SQL, Tables)
from stylograin.functions.labels import rule_prediction
from stylograin.functions.text import words
from stylograin.functions.arrays import head
from stylograin.operators import metrics as m
from stylograin.operators.joins import attach_predictions
from stylograin.operators.trees import shape_features
from stylograin.session import scratch_path
from stylograin.sources import normalise as n
from stylograin.sources import sinks


@query("s01_split_scan", """SELECT 'train' AS split, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents
  UNION ALL SELECT 'val', count(*), sum(length(text))::BIGINT FROM conversations
  UNION ALL SELECT 'test_sample', count(*), sum(length(text))::BIGINT FROM benchmark""")
def split_scan(t: Tables):
    paths = {"train": t.path("documents"), "val": t.path("conversations"), "test_sample": t.path("benchmark")}
    return n.read_splits(t.spark, paths, ["text"]).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("s02_column_normaliser", """SELECT d.doc_id, length(text) AS n_code, lang, l.quality AS label
  FROM documents d JOIN labels l USING (doc_id)""")
def column_normaliser(t: Tables):
    docs = t.table("documents").select("doc_id", F.col("text").alias(" Text"), F.col("lang").alias("LANG"))
    labels = t.table("labels").select("doc_id", F.col("quality").cast("string").alias("Target "))
    df = n.normalised_columns(docs.join(labels, "doc_id"))
    return df.select("doc_id", F.length("code").cast("bigint").alias("n_code"), "lang", "label")


@query("s03_missing_column_defaults", f"""WITH {SAMPLES_SQL} SELECT sample_id, coalesce(label, -1) AS label,
  'Python' AS language FROM samples""")
def missing_column_defaults(t: Tables):
    return n.with_defaults(t.all_listing().select("sample_id", "label"), "Python")


@query("s04_bounded_prefix", "SELECT doc_id AS sample_id, lang AS language FROM documents ORDER BY doc_id LIMIT 100")
def bounded_prefix(t: Tables):
    return n.first_rows(t.listing(), 100, "sample_id").select("sample_id", "language")


@query("s05_prediction_attach", f"""WITH {SAMPLES_SQL} SELECT sample_id, label, {RULE_SQL} AS pred,
  CAST({RULE_SQL} = label AS INTEGER) AS correct FROM samples WHERE label IS NOT NULL""")
def prediction_attach(t: Tables):
    path = scratch_path(t.spark, "predictions")
    t.judged().select("sample_id", "pred").write.parquet(path)
    return attach_predictions(t.labelled_listing().select("sample_id", "label"), t.spark.read.parquet(path))


@query("s06_materialised_features", f"""WITH {NODES_SQL} SELECT sample_id, count(*)::DOUBLE AS total_nodes,
  max(depth)::DOUBLE AS max_depth FROM nodes GROUP BY 1""")
def materialised_features(t: Tables):
    folder = scratch_path(t.spark, "features")

    def compute():
        return shape_features(t.nodes()).select("sample_id", "total_nodes", "max_depth")

    sinks.materialised(t.spark, folder, "all", "markup", compute)
    return sinks.materialised(t.spark, folder, "all", "markup", compute)


@query("s07_results_csv", f"""WITH {SCORED_SQL}, {CUTS_SQL}, {conf_sql('model, grp', 'many')}
  SELECT model, grp, round({COUNT_SQL['accuracy']}, 6) AS accuracy, round({COUNT_SQL['macro_f1']}, 6) AS macro_f1 FROM conf""")
def results_csv(t: Tables):
    c = m.count_metrics()
    rows = m.confusion_counts(by_cut(t), ["model", "grp"]).select(
        "model", "grp", c["accuracy"].alias("accuracy"), c["macro_f1"].alias("macro_f1"),
        F.array("tp", "fp").alias("nested"))
    path = scratch_path(t.spark, "results")
    sinks.write_results_csv(rows, path)
    return t.spark.read.option("header", True).schema(
        "model string, grp int, accuracy double, macro_f1 double").csv(path)


@query("s08_metrics_json", f"""WITH {HISTORY_SQL} SELECT epoch, round(macro_f1, 6) AS macro_f1,
  (SELECT epoch FROM history ORDER BY history.macro_f1 DESC, epoch LIMIT 1) AS best_epoch FROM history""")
def metrics_json(t: Tables):
    rows = history(t)
    path = scratch_path(t.spark, "metrics")
    sinks.metrics_json(m.best_row(rows, "macro_f1", "epoch"), rows, "epoch").write.text(path)
    back = t.spark.read.schema("best struct<epoch: int, macro_f1: double>, "
                               "history array<struct<epoch: int, macro_f1: double>>").json(path)
    return back.select(F.col("best.epoch").alias("best_epoch"), F.inline("history")).select(
        "epoch", "macro_f1", "best_epoch")


@query("s09_submission_numbered", f"""WITH {DOCS_SQL} SELECT row_number() OVER (ORDER BY sample_id) - 1 AS id,
  {RULE_SQL} AS label FROM docs""")
def submission_numbered(t: Tables):
    rows = t.documents().select("sample_id", rule_prediction(F.col("code"), MARKERS).alias("pred"))
    path = scratch_path(t.spark, "submission")
    sinks.submission(rows, "pred", "sample_id").write.option("header", True).csv(path)
    return t.spark.read.option("header", True).schema("id bigint, label int").csv(path)


@query("s09_submission_with_id", f"WITH {DOCS_SQL} SELECT sample_id AS id, {RULE_SQL} AS label FROM docs")
def submission_with_id(t: Tables):
    rows = t.documents().select(F.col("sample_id").alias("ID"), rule_prediction(F.col("code"), MARKERS).alias("pred"))
    return sinks.submission(rows)


@query("s10_encoded_dataset", r"""SELECT CASE WHEN lang IN ('de', 'es') OR (doc_id // 20) % 10 = 9 THEN 'ood'
    WHEN (doc_id // 20) % 10 IN (7, 8) THEN 'val' ELSE 'train' END AS split, doc_id AS sample_id,
  least(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')), 512)::INTEGER AS n_ids FROM documents""")
def encoded_dataset(t: Tables):
    ids = F.transform(head(words(F.col("code"))), lambda w: F.length(w))
    rows = t.documents().select("sample_id", "code", "split", ids.alias("input_ids"))
    path = scratch_path(t.spark, "encoded")
    sinks.write_encoded(rows, path)
    return t.spark.read.parquet(path).select("split", "sample_id", F.size("input_ids").alias("n_ids"))


@query("s11_text_report", f"""WITH {SCORED_SQL}, {conf_sql()}, r AS (SELECT {', '.join(f'{COUNT_SQL[x]} AS {x}' for x in
    ('accuracy', 'binary_f1', 'macro_f1', 'macro_precision', 'macro_recall', 'mcc', 'fnr'))} FROM conf),
  l AS (SELECT unnest([{', '.join(f"printf('%-20s: %.4f', '{x}', {x})" for x in
    ('accuracy', 'binary_f1', 'macro_f1', 'macro_precision', 'macro_recall', 'mcc', 'fnr'))}]) AS line FROM r)
  SELECT line FROM l UNION ALL SELECT 'Events' UNION ALL SELECT repeat('=', 55)""")
def text_report(t: Tables):
    names = ["accuracy", "binary_f1", "macro_f1", "macro_precision", "macro_recall", "mcc", "fnr"]
    c = m.count_metrics()
    row = m.confusion_counts(t.scored()).select(*[c[x].alias(x) for x in names])
    path = scratch_path(t.spark, "report")
    sinks.report_lines(row, names, F.lit("Events")).orderBy("line_no").select("line").write.text(path)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


@query("s11_summary_lines", f"""WITH {SCORED_SQL}, {CUTS_SQL}, part AS (SELECT model, CASE WHEN grp < 4 THEN 'val' ELSE 'ood' END AS split, y, pred FROM many),
  {conf_sql('model, split', 'part')}, r AS (SELECT model, max({COUNT_SQL['macro_f1']}) FILTER (split = 'val') AS v,
    max({COUNT_SQL['macro_f1']}) FILTER (split = 'ood') AS o FROM conf GROUP BY 1)
  SELECT printf('%s: val=%.4f, ood=%.4f, gain=%+.4f', model, v, o, o - first_value(o) OVER (ORDER BY model)) AS line FROM r""")
def summary_lines(t: Tables):
    rows = by_cut(t).withColumn("split", F.when(F.col("grp") < 4, "val").otherwise("ood"))
    results = m.confusion_counts(rows, ["model", "split"]).select(
        "model", "split", m.count_metrics()["macro_f1"].alias("f1"))
    table = m.comparison_table(m.shift_drop(results, "model", "split", "f1"), "ood_f1", "model")
    return sinks.summary_lines(table)

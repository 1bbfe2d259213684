"""Fitted models. Fits have no SQL twin; weights and contributions do.

Vocabularies, forests, rounds of boosting and tolerances are the library's defaults.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stylograin.catalog.registry import query
from stylograin.catalog.surface import KEYWORDS, MARKS
from stylograin.catalog.tables import SAMPLES_SQL, Tables
from stylograin.catalog.terms import CLASS_WEIGHTS_SQL, class_weights
from stylograin.functions.text import surface_features, words
from stylograin.operators import models as m
from stylograin.operators.terms import class_means
from stylograin.operators.trees import SHAPE_FEATURES, shape_features
from stylograin.plans import studies as s

ROUNDS = 500  # over shape features
PATH_ROUNDS = 300


#: What stands for decisions and calls in the trees of pages.
PAGE_MARKS = {"decisions": ["li", "p"], "call_mark": "a"}


def samples(t: Tables):
    return t.labelled().select("sample_id", "code", "language", "split", "label")


def lexical(t: Tables):
    return s.lexical_rows(samples(t), words, 150_000)


def shapes(t: Tables):
    """Pages with their 18 shape features."""
    features = shape_features(t.nodes(), **PAGE_MARKS)
    return t.pages().drop("code").join(features, "sample_id")


def scaled_shapes(t: Tables):
    return s.scaled_rows(shapes(t), SHAPE_FEATURES)


def run(rows, name: str, fit):
    return s.results(s.run_models(rows, {name: fit}))


@query("ml01_logistic_regression")
def logistic_regression(t: Tables):
    return run(lexical(t), "logistic", m.logistic())


@query("ml02_balanced_weights", f"""WITH {SAMPLES_SQL}, l AS (SELECT * FROM samples WHERE label IS NOT NULL)
  SELECT label, count(*) AS n, round((SELECT count(*) FROM l) / (2.0::DOUBLE * count(*)), 6) AS weight FROM l GROUP BY 1""")
def balanced_weights(t: Tables):
    rows = m.with_balanced_weights(t.labelled_listing().select("label"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))


@query("ml03_balanced_logistic_regression")
def balanced_logistic(t: Tables):
    return run(lexical(t), "balanced logistic", m.logistic(balanced=True))


@query("ml04_linear_svm")
def linear_svm(t: Tables):
    return run(scaled_shapes(t), "svm", m.linear_svm())


@query("ml05_random_forest")
def random_forest(t: Tables):
    return run(scaled_shapes(t), "random forest", m.random_forest())


@query("ml06_boosted_trees")
def boosted_trees(t: Tables):
    return run(scaled_shapes(t), "boosted trees", m.boosted_trees(ROUNDS))


@query("ml07_weighted_boosted_trees")
def weighted_boosted_trees(t: Tables):
    return run(scaled_shapes(t), "weighted boosted trees", m.boosted_trees(ROUNDS, ratio_weighted=True))


@query("ml07_ratio_weights", f"""WITH {SAMPLES_SQL}, l AS (SELECT * FROM samples WHERE label IS NOT NULL AND split = 'train')
  SELECT label, count(*) AS n, CASE label WHEN 1 THEN round((SELECT count(*) FILTER (label = 0) / count(*) FILTER (label = 1) FROM l), 6)
  ELSE 1 END AS weight FROM l GROUP BY 1""")
def ratio_weights(t: Tables):
    rows = m.with_ratio_weights(t.labelled_listing().where(F.col("split") == "train").select("label"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))


@query("ml08_calibrated_svm")
def calibrated_svm(t: Tables):
    return run(scaled_shapes(t), "calibrated svm", m.calibrated_svm())


@query("ml09_length_only")
def length_only(t: Tables):
    return m.length_only_accuracy(t.judged(), F.col("words"))


@query("ml10_batch_scoring")
def batch_scoring(t: Tables):
    return s.run_models(lexical(t), {"logistic": m.logistic()})


@query("ml10_linear_scoring", f"""WITH {CLASS_WEIGHTS_SQL}, n AS (SELECT count(*) FILTER (label = 0) AS n0,
    count(*) FILTER (label = 1) AS n1 FROM labelled),
  c AS (SELECT term, coalesce(sum(weight) FILTER (label = 1), 0) / any_value(n1)
    - coalesce(sum(weight) FILTER (label = 0), 0) / any_value(n0) AS coef FROM weights, n GROUP BY 1),
  x AS (SELECT sample_id, sum(weight * coef) AS s FROM weights JOIN c USING (term) GROUP BY 1)
  SELECT labelled.sample_id, round(coalesce(s, 0) - 0.01, 6) AS score, CAST(coalesce(s, 0) - 0.01 > 0 AS INTEGER) AS pred
  FROM labelled LEFT JOIN x USING (sample_id)""")
def linear_scoring(t: Tables):
    weights = class_weights(t)
    listing = t.labelled_listing()
    coefficients = class_means(weights, listing).select("term", F.col("difference").alias("coefficient"))
    return m.linear_scores(listing, weights, coefficients, -0.01, 2000)


@query("ml11_feature_importance")
def feature_importance(t: Tables):
    rows = scaled_shapes(t)
    model = m.random_forest()(s.of_split(rows, "train"))
    return m.importance_rows(model, SHAPE_FEATURES, rows).orderBy(F.desc("importance"), "term")


def surface_rows(t: Tables):
    features = surface_features(F.col("code"), KEYWORDS, MARKS)
    rows = samples(t).select(*s.KEEP, "label", *[c.alias(n) for n, c in features.items()])
    return s.scaled_rows(rows, list(features)), list(features)


@query("ml12_permutation_importance")
def permutation_importance(t: Tables):
    rows, names = surface_rows(t)
    model = m.logistic(balanced=True)(s.of_split(rows, "train"))
    return m.permutation_importance(model, s.of_split(rows, "ood"), names)


@query("ml13_linear_contributions", f"""WITH {CLASS_WEIGHTS_SQL}, n AS (SELECT count(*) FILTER (label = 0) AS n0,
    count(*) FILTER (label = 1) AS n1, count(*) AS n FROM labelled),
  c AS (SELECT term, sum(weight) / any_value(n) AS mean, any_value(n) AS n,
    coalesce(sum(weight) FILTER (label = 1), 0) / any_value(n1) - coalesce(sum(weight) FILTER (label = 0), 0) / any_value(n0) AS coef
    FROM weights, n GROUP BY 1)
  SELECT term, round(abs(any_value(coef)) * (sum(abs(weight - mean)) + (any_value(n) - count(*)) * abs(any_value(mean))) / any_value(n), 6) AS contribution
  FROM weights JOIN c USING (term) GROUP BY 1""")
def linear_contributions(t: Tables):
    weights = class_weights(t)
    coefficients = class_means(weights, t.labelled_listing()).select("term", F.col("difference").alias("coefficient"))
    n = t.labelled_listing().agg(F.count(F.lit(1))).scalar()
    return m.linear_contributions(weights, coefficients, n, 2000)


@query("ml20_cluster_summary")
def cluster_summary(t: Tables):
    return m.cluster_summary(t.table("embeddings"), "embedding", 20).select(
        "cluster", "n", F.get("centre", F.lit(0)).alias("first_coordinate"))

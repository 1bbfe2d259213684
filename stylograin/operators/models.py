"""Classifiers on Spark ML: weights, fits, scoring, importance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylograin.operators import boosting, forest, linear
from stylograin.operators.isotonic import IsotonicModel
from stylograin.operators.joins import bounded
from stylograin.operators.metrics import confusion_counts, count_metrics
from stylograin.operators.ordering import hash_key
from stylograin.operators.sampling import folds, stratified_split
from stylograin.session import importable_on_workers, reused

Fit = Callable[[DataFrame], object]


def with_balanced_weights(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Weight ``N / (2 * n_class)``; the class sizes are one row, read as a scalar."""
    sizes = df.agg(F.struct(F.count(label).alias("n"), F.count_if(F.col(label) == 0).alias("n0"),
                            F.count_if(F.col(label) == 1).alias("n1")))
    n_class = F.when(F.col(label) == 1, F.col("_sizes.n1")).otherwise(F.col("_sizes.n0"))
    return (df.withColumn("_sizes", sizes.scalar())
            .withColumn(name, F.col("_sizes.n") / (2.0 * n_class)).drop("_sizes"))


def with_ratio_weights(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Weight 1 for human and ``n_human / n_machine`` for machine rows."""
    ratio = df.agg(F.count_if(F.col(label) == 0) / F.count_if(F.col(label) == 1)).scalar()
    return df.withColumn(name, F.when(F.col(label) == 1, ratio).otherwise(1.0))


def weighted(train: DataFrame, label: str, kind: str | None, name: str = "weight") -> tuple[DataFrame, int]:
    """The training rows with their weights as constants, and their number: one aggregate tells both.

    ``kind`` is "balanced", "ratio" or nothing, as in the two functions above.
    """
    n, n0, n1 = train.agg(F.count(label), F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    weights = {"balanced": (n / (2.0 * n0) if n0 else 1.0, n / (2.0 * n1) if n1 else 1.0),
               "ratio": (1.0, n0 / n1 if n1 else 1.0), None: (1.0, 1.0)}[kind]
    return train.withColumn(name, F.when(F.col(label) == 1, weights[1]).otherwise(weights[0])), n


def logistic(balanced: bool = False, max_iter: int = 1000, c: float = 1.0, tol: float = 1e-5, features: str = "features",
             label: str = "label") -> Fit:
    """L2 logistic regression, ``c`` on the sum of losses, not standardised; steps end at a gradient of ``tol`` times the first."""
    def fit(train: DataFrame):
        rows, _ = weighted(train, label, "balanced" if balanced else None)
        return linear.fitted(rows, linear.LOGISTIC, c, tol, max_iter, features, label, "weight")
    return fit


def linear_svm(max_iter: int = 5000, c: float = 1.0, tol: float = 1e-4, features: str = "features", label: str = "label") -> Fit:
    """Balanced linear SVM (squared hinge); steps end at a duality gap of ``tol`` times the objective."""
    def fit(train: DataFrame):
        rows, _ = weighted(train, label, "balanced")
        return linear.fitted(rows, linear.SQUARED_HINGE, c, tol, max_iter, features, label, "weight")
    return fit


def random_forest(trees: int = 300, depth: int = 20, min_leaf: int = 5, seed: int = 42,
                  features: str = "features", label: str = "label") -> Fit:
    """Balanced trees on bootstraps, of the square root of all features tried at each node, split by Gini impurity."""
    def fit(train: DataFrame):
        rows, _ = weighted(train, label, "balanced")
        return forest.fitted(rows, trees, depth, min_leaf, seed, features, label, "weight")
    return fit


def boosted_trees(rounds: int = 300, depth: int = 6, rate: float = 0.1, ratio_weighted: bool = False, l2: float = 3.0,
                  bins: int = 64, features: str = "features", label: str = "label") -> Fit:
    """Gradient-boosted symmetric trees on the logistic loss; ``ratio_weighted`` gives machine rows ``n_human / n_machine`` of train."""
    def fit(train: DataFrame):
        rows, _ = weighted(train, label, "ratio" if ratio_weighted else None)
        return boosting.fitted(rows, rounds, depth, rate, l2, bins, features, label, "weight")
    return fit


class CalibratedModel:
    """Mean of the calibrated probabilities of several (classifier, isotonic) pairs."""

    def __init__(self, pairs: Sequence[tuple], features: str):
        self.pairs, self.features = list(pairs), features

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, (svm, isotonic) in enumerate(self.pairs):
            out = margin(svm, out).drop("rawPrediction", "prediction")
            out = isotonic.transform(out).withColumnRenamed("prediction", f"_p{i}").drop("margin")
        names = [f"_p{i}" for i in range(len(self.pairs))]
        p = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
        return out.withColumn("p", p).drop(*names).withColumn("prediction", (F.col("p") > 0.5).cast("double"))


def margin(svm, df: DataFrame) -> DataFrame:
    return svm.transform(df).withColumn("margin", vector_to_array("rawPrediction")[1])


def calibrated_svm(k: int = 3, max_iter: int = 5000, key: str = "sample_id", features: str = "features",
                   label: str = "label") -> Fit:
    """Per fold: SVM on the other folds, isotonic curve on the margins of this one."""
    def fit(train: DataFrame):
        rows = reused(folds(train, label, k, key))
        pairs = []
        for fold in range(k):
            svm = linear_svm(max_iter, features=features, label=label)(rows.where(F.col("fold") != fold))
            held_out = margin(svm, rows.where(F.col("fold") == fold)).select(
                "margin", F.col(label).cast("double").alias(label))
            pairs.append((svm, IsotonicModel(held_out, "margin", label)))
        return CalibratedModel(pairs, features)
    return fit


def scored(model, df: DataFrame, keep: Sequence[str], label: str = "label") -> DataFrame:
    """(keep…, y, pred, score): probability of machine where the model has one, else its margin."""
    out = model.transform(df)
    if "p" in out.columns:
        score = F.col("p")
    elif "probability" in out.columns:
        score = vector_to_array("probability")[1]
    else:
        score = vector_to_array("rawPrediction")[1]
    return out.select(*keep, F.col(label).cast("int").alias("y"),
                      F.col("prediction").cast("int").alias("pred"), score.alias("score"))


def linear_scores(samples: DataFrame, values: DataFrame, coefficients: DataFrame, intercept: float = 0.0,
                  max_features: int | None = None, key: str = "sample_id", term: str = "term",
                  value: str = "weight") -> DataFrame:
    """Decision values of a linear model over a long feature table: (key, score, pred).

    A sample without any known feature keeps its row and scores the intercept.
    """
    known = values.join(bounded(coefficients, max_features), term)
    sums = known.groupBy(key).agg(F.sum(F.col(value) * F.col("coefficient")).alias("_sum"))
    scores = samples.select(key).join(sums, key, "left").select(
        key, (F.coalesce("_sum", F.lit(0.0)) + F.lit(intercept)).alias("score"))
    return scores.withColumn("pred", (F.col("score") > 0).cast("int"))


def importance_rows(model, names: Sequence[str], df: DataFrame) -> DataFrame:
    """(term, importance) of a tree model, or of the coefficients of a linear one."""
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    rows = [(name, float(value)) for name, value in zip(names, values.toArray())]
    return df.sparkSession.createDataFrame(rows, "term string, importance double")


def permutation_importance(model, df: DataFrame, columns: Sequence[str], key: str = "sample_id",
                           features: str = "features", label: str = "label", seed: int = 42,
                           rows_per_bucket: int = 10_000) -> DataFrame:
    """Loss of macro F1 when one feature is permuted, for all features in one pass.

    A row borrows the feature from the next row in random order; the order is cut into
    buckets by hash, each rotated on its own. One shuffle serves every feature. Only the
    slots in which a row and its partner differ are judged again, as the others cannot
    change a prediction; a linear model needs the two values and its margin for that, and no
    vector.
    """
    judged = model.transform(df)
    arrays = judged.select(key, F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"),
                           vector_to_array("rawPrediction")[1].alias("margin"), vector_to_array(features).alias("x"))
    arrays = arrays.withColumn("_key", hash_key(key, seed))
    n = df.agg(F.count(F.lit(1))).scalar()
    buckets = F.greatest(F.lit(1), F.ceil(n / rows_per_bucket)).cast("bigint")
    placed = arrays.withColumn("_bucket", F.pmod(F.xxhash64("_key"), buckets))
    in_order = Window.partitionBy("_bucket").orderBy("_key")
    paired = placed.withColumn("partner", F.coalesce(F.lead("x").over(in_order), F.first("x").over(in_order)))
    slots = F.filter(F.sequence(F.lit(0), F.lit(len(columns) - 1)), lambda i: F.get("x", i) != F.get("partner", i))
    mixed = paired.withColumn("slot", F.explode(slots))
    before, after = F.get("x", F.col("slot")), F.get("partner", F.col("slot"))
    if hasattr(model, "coefficients"):
        weights = F.array(*[F.lit(float(c)) for c in model.coefficients.toArray()])
        moved = F.col("margin") + F.get(weights, F.col("slot")) * (after - before)
        changed = mixed.select("slot", "y", F.col("pred").alias("old"), (moved > 0).cast("int").alias("new"))
    else:
        x = F.transform("x", lambda v, i: F.when(i == F.col("slot"), after).otherwise(v))
        again = model.transform(mixed.select("slot", "y", F.col("pred").alias("old"), array_to_vector(x).alias(features)))
        changed = again.select("slot", "y", "old", F.col("prediction").cast("int").alias("new"))
    outcomes = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}
    moves = changed.where(F.col("old") != F.col("new")).groupBy("slot").agg(*[
        (F.count_if((F.col("y") == a) & (F.col("new") == b)) - F.count_if((F.col("y") == a) & (F.col("old") == b))).alias(f"d_{name}")
        for name, (a, b) in outcomes.items()])
    base = confusion_counts(arrays).select(F.struct(*outcomes).alias("base"))
    every = (df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("slot"))
             .withColumn("_base", base.scalar()).join(moves, "slot", "left"))
    f1 = count_metrics()["macro_f1"]
    whole = every.select("slot", "_base.*").select("slot", f1.alias("base"))
    after_move = every.select("slot", *[(F.col(f"_base.{n}") + F.coalesce(f"d_{n}", F.lit(0))).alias(n) for n in outcomes])
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("slot") + 1)
    return (after_move.select("slot", f1.alias("f1")).join(whole, "slot")
            .select(name.alias("feature"), (F.col("base") - F.col("f1")).alias("importance")))


def linear_contributions(values: DataFrame, coefficients: DataFrame, n: Column,
                         max_features: int | None = None, term: str = "term",
                         value: str = "weight") -> DataFrame:
    """Mean |coefficient * (x - mean)| per feature of a long feature table, absent values being 0.

    Per feature the table is added up twice: for the mean, then for the distances to it.
    """
    means = values.groupBy(term).agg((F.sum(value) / F.first(n)).alias("mean"))
    known = means.join(bounded(coefficients, max_features), term)
    apart = values.join(bounded(known, max_features), term).groupBy(term, "mean", "coefficient").agg(
        F.sum(F.abs(F.col(value) - F.col("mean"))).alias("present"), F.count(F.lit(1)).alias("k"))
    total = F.col("present") + (n - F.col("k")) * F.abs("mean")
    return apart.select(term, (F.abs("coefficient") * total / n).alias("contribution"))


def length_only_accuracy(df: DataFrame, length: Column, languages: Sequence[str] | None = None, language: str = "language",
                         key: str = "sample_id", label: str = "label") -> DataFrame:
    """Accuracy of a logistic model that sees the length only: (level, scope, n_test, accuracy).

    Level ``all`` is one model for all rows, with scope ``all``; level ``language`` has one
    per language, null included, or per language of a list. Where the training part has one class
    only, no model can be fitted: the row is there with the size of its test part and no
    accuracy. All scopes are fitted in one plan: equal lengths are counted first, so
    that a scope's task gets a row per distinct length, class and part.
    """
    scopes = F.array(F.struct(F.lit("all").alias("level"), F.lit("all").alias("scope")),
                     F.struct(F.lit("language").alias("level"), F.col(language).cast("string").alias("scope")))
    rows = df.where(F.col(label).isNotNull()).select(key, F.col(label).cast("int").alias("y"), length.cast("double").alias("x"), F.explode(scopes).alias("_s"))
    if languages is not None:
        rows = rows.where((F.col("_s.level") == "all") | F.col("_s.scope").isin(list(languages)))
    rows = rows.withColumn("_stratum", F.struct("_s.level", "_s.scope", "y"))
    split = stratified_split(rows, "_stratum", 0.2, key)
    counts = split.groupBy("_s.level", "_s.scope", "part", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    importable_on_workers(df.sparkSession)

    def judge(table: pa.Table) -> pa.Table:
        part, x, y, n = (table.column(name).to_numpy() for name in ("part", "x", "y", "n"))
        train, x = part == "train", np.nan_to_num(x)
        correct = None
        if len(np.unique(y[train])) == 2:
            block = linear.Block.of_column(x[train], y[train], n[train], linear.LOGISTIC)
            weights = linear.solved(block.value_and_gradient, block.product, 1, 1.0, linear.LOGISTIC, 1e-8, 100).x
            right = (x[~train] * weights[0] + weights[1] > 0) == (y[~train] == 1)
            correct = float(n[~train][right].sum())
        n_test = int(n[~train].sum())
        accuracy = correct / n_test if correct is not None and n_test else None
        return pa.table({"level": table.column("level")[:1], "scope": table.column("scope")[:1], "n_test": pa.array([n_test], pa.int64()),
                         "accuracy": pa.array([accuracy], pa.float64())})

    return counts.groupBy("level", "scope").applyInArrow(judge, "level string, scope string, n_test bigint, accuracy double")


def cluster_summary(df: DataFrame, vector: str, k: int = 20, seed: int = 42) -> DataFrame:
    """Sizes and centres of k-means clusters."""
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    sizes = model.transform(rows).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    centres = [(i, [float(v) for v in centre]) for i, centre in enumerate(model.clusterCenters())]
    table = df.sparkSession.createDataFrame(centres, "cluster int, centre array<double>")
    return table.join(sizes, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"), "centre")

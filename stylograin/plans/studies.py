"""Studies: features, several models, several splits, one table of results.

A study scores every model on every split into one long table
``(model, split, language, sample_id, y, pred, score)``; all metrics then come from one
aggregate over that table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylograin.functions.text import CODE_KEYWORDS, CODE_MARKS, char_ngrams, surface_features, words, words_and_bigrams
from stylograin.operators import metrics
from stylograin.operators.features import ScaledColumns, TfidfVectors, assembled
from stylograin.operators.grams import GramVectors
from stylograin.operators.models import (Fit, boosted_trees, calibrated_svm, importance_rows, linear_svm, logistic,
                                         random_forest, scored)
from stylograin.operators.ranking import ranked, two_sided
from stylograin.operators.sampling import sample_per_group
from stylograin.operators.terms import class_means, tfidf
from stylograin.operators.trees import (ROLE_TYPES, SHAPE_FEATURES, basic_features, path_tokens, role_features,
                                        shape_features, with_missing_as_zero)
from stylograin.session import reused

KEEP = ["sample_id", "language", "split"]


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def of_split(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split)


def run_models(rows: DataFrame, fits: Mapping[str, Fit], label: str = "label") -> DataFrame:
    """Fit every model on ``train`` and score the other splits of ``rows`` (with ``features``)."""
    train, rest = of_split(rows, "train"), rows.where(F.col("split") != "train")
    return union_all([scored(fit(train), rest, KEEP, label).withColumn("model", F.lit(name))
                      for name, fit in fits.items()])


def results(predictions: DataFrame) -> DataFrame:
    """The full metric row per model and split."""
    return metrics.metric_rows(predictions, ["model", "split"])


def results_by_language(predictions: DataFrame) -> DataFrame:
    return metrics.metric_rows(predictions, ["model", "split", "language"]).where(
        (F.col("n_machine") > 0) & (F.col("n_machine") < F.col("n_samples")))


def lexical_rows(samples: DataFrame, tokens, max_features: int, min_df: int = 1, sublinear: bool = False,
                 scaled: bool = False, train: DataFrame | None = None, text: str = "code") -> DataFrame:
    """Samples with TF-IDF vectors, fitted on ``train`` (by default the train split)."""
    if tokens is char_ngrams:  # counted without a string for each
        fitted_on = of_split(samples, "train") if train is None else train
        return GramVectors(text, "features", max_features, min_df, sublinear, scaled).fit(fitted_on).transform(samples)
    with_tokens = samples.withColumn("tokens", tokens(F.col(text))).drop(text)
    fitted_on = (of_split(with_tokens, "train") if train is None
                 else train.withColumn("tokens", tokens(F.col(text))).drop(text))
    model = TfidfVectors("tokens", "features", max_features, min_df, sublinear, scaled).fit(fitted_on)
    return reused(model.transform(with_tokens).drop("tokens"))


def baseline_family(samples: DataFrame, word_features: int = 150_000, bigram_features: int = 120_000,
                    char_features: int = 100_000, min_df: int = 5, per_language: int = 15_000,
                    max_iter: int = 1000) -> DataFrame:
    """Predictions of the four lexical baselines on the splits other than train.

    ``per_language`` bounds the training rows of the fourth: at most so many of each
    language, by hash. The others are fitted on all rows.
    """
    plain, balanced = logistic(max_iter=max_iter), logistic(balanced=True, max_iter=max_iter)
    even = sample_per_group(of_split(samples, "train"), per_language, ["language"])
    even_rows = even.unionByName(samples.where(F.col("split") != "train"))
    return union_all([
        run_models(lexical_rows(samples, words, word_features), {"vanilla": plain}),
        run_models(lexical_rows(samples, words_and_bigrams, bigram_features, min_df, True), {"improved": balanced}),
        run_models(lexical_rows(samples, char_ngrams, char_features, min_df, True), {"char": balanced}),
        run_models(lexical_rows(even_rows, char_ngrams, char_features, min_df, True), {"balanced": balanced}),
    ])


def scaled_rows(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return reused(ScaledColumns(columns, "features").fit(of_split(rows, "train")).transform(rows))


def shift_diagnostic(samples: DataFrame, nodes: DataFrame, language: str, char_features: int = 100_000,
                     min_df: int = 5, keywords: Mapping[str, str] = CODE_KEYWORDS,
                     marks: Mapping[str, str] = CODE_MARKS, roles: Mapping[str, Sequence[str]] = ROLE_TYPES,
                     max_iter: int = 1000) -> DataFrame:
    """Surface features of all languages against text and tree features of one language."""
    fit = logistic(balanced=True, max_iter=max_iter)
    features = surface_features(F.col("code"), keywords, marks)
    surface = samples.select(*KEEP, "label", *[c.alias(n) for n, c in features.items()])
    one = samples.where(F.col("language") == language)
    slim = one.select(*KEEP, "label")
    basic = with_missing_as_zero(slim, basic_features(nodes, roles=roles))
    enhanced = with_missing_as_zero(slim, role_features(nodes, roles=roles))
    extra = [*KEEP, "label"]
    return union_all([
        run_models(scaled_rows(surface, list(features)), {"surface, all languages": fit}),
        run_models(lexical_rows(one, char_ngrams, char_features, min_df, True, scaled=True), {"char, one language": fit}),
        run_models(scaled_rows(basic, [c for c in basic.columns if c not in extra]), {"tree 8, one language": fit}),
        run_models(scaled_rows(enhanced, [c for c in enhanced.columns if c not in extra]), {"tree 15, one language": fit}),
    ])


def shape_model_run(samples: DataFrame, nodes: DataFrame, fits: Mapping[str, Fit], **marks) -> DataFrame:
    """Predictions from the 18 shape features, scaled; a sample without a tree has zeros.

    ``marks`` name the decision and call nodes of the trees, as for ``shape_features``.
    """
    shapes = with_missing_as_zero(samples.select(*KEEP, "label"), shape_features(nodes, **marks))
    return run_models(scaled_rows(shapes, SHAPE_FEATURES), fits)


def path_rows(samples: DataFrame, nodes: DataFrame, max_features: int = 2000, min_df: int = 5,
              without_errors: bool = False, mapping: Mapping[str, str] | None = None,
              error: str = "error") -> tuple[DataFrame, list[str]]:
    """Samples with path TF-IDF vectors, and the names of the vector's slots."""
    documents = reused(path_tokens(nodes, samples.select(*KEEP, "label"), without_errors=without_errors,
                                   mapping=mapping, error=error))
    return weighed_paths(documents, max_features, min_df)


def weighed_paths(documents: DataFrame, max_features: int, min_df: int) -> tuple[DataFrame, list[str]]:
    model = TfidfVectors("paths", "features", max_features, min_df).fit(of_split(documents, "train"))
    return reused(model.transform(documents).drop("paths")), model.terms


def tree_models(trees: int = 300, depth: int = 20, rounds: int = 300, max_iter: int = 5000) -> dict[str, Fit]:
    """The three classifiers of the path and shape runs."""
    return {"random forest": random_forest(trees, depth), "svm": linear_svm(max_iter),
            "boosted trees": boosted_trees(rounds)}


def path_model_run(samples: DataFrame, nodes: DataFrame, fits: Mapping[str, Fit], without_errors: bool = False,
                   max_features: int = 2000, min_df: int = 5, error: str = "error") -> DataFrame:
    """Predictions of the path models; ``without_errors`` drops edges that touch an error."""
    rows, _ = path_rows(samples, nodes, max_features, min_df, without_errors, error=error)
    return run_models(rows, fits)


def robustness_study(samples: DataFrame, nodes: DataFrame, mapping: Mapping[str, str], rounds: int = 300,
                     max_iter: int = 5000, min_df: int = 5) -> DataFrame:
    """Predictions of three ways to meet the class shift and two to meet the language shift."""
    standard, _ = path_rows(samples, nodes, min_df=min_df)
    universal, _ = path_rows(samples, nodes, min_df=min_df, mapping=mapping)
    default, weighted = boosted_trees(rounds), boosted_trees(rounds, ratio_weighted=True)
    return run_models(standard, {
        "1 standard paths + default": default, "2 standard paths + class-weighted": weighted,
        "3 standard paths + calibrated": calibrated_svm(max_iter=max_iter),
    }).unionByName(run_models(universal, {
        "4 universal paths + default": default, "5 universal paths + class-weighted": weighted}))


def robustness_table(predictions: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """Known and shifted score per method, gain over the first method, mark for the best."""
    counts = metrics.confusion_counts(predictions, ["model", "split"])
    rows = counts.select("model", "split", metrics.count_metrics()[metric].alias(metric))
    return metrics.comparison_table(metrics.shift_drop(rows, "model", "split", metric), f"ood_{metric}", "model")


def language_gain(predictions: DataFrame, first: str, second: str, split: str = "ood") -> DataFrame:
    """Macro F1 of two models per language that holds both classes, gain and mark."""
    rows = results_by_language(of_split(predictions, split)).select("model", "language", "macro_f1")
    a, b = (rows.where(F.col("model") == name) for name in (first, second))
    return metrics.variant_comparison(a, b, "language", "macro_f1")


def fusion_study(samples: DataFrame, nodes: DataFrame, rounds: int = 300, min_df: int = 5, **marks) -> DataFrame:
    """Predictions from paths, from tree shape, and from both together; ``marks`` as for ``shape_features``."""
    paths, _ = path_rows(samples, nodes, min_df=min_df)
    shapes = with_missing_as_zero(samples.select(*KEEP, "label"), shape_features(nodes, **marks))
    scalars = scaled_rows(shapes, SHAPE_FEATURES).select("sample_id", F.col("features").alias("shape"))
    both = reused(paths.withColumnRenamed("features", "path").join(scalars, "sample_id"))
    fit = boosted_trees(rounds)
    return union_all([
        run_models(both.withColumnRenamed("path", "features"), {"paths": fit}),
        run_models(both.withColumnRenamed("shape", "features"), {"shape": fit}),
        run_models(reused(assembled(both, ["path", "shape"])), {"fusion": fit}),
    ])


def fusion_table(predictions: DataFrame) -> DataFrame:
    """Gain of fusion over paths per split, and the verdict."""
    counts = metrics.confusion_counts(predictions, ["model", "split"])
    rows = counts.select("model", "split", metrics.count_metrics()["macro_f1"].alias("f1"))

    def of(model: str):
        return F.max(F.when(F.col("model") == model, F.col("f1")))

    table = rows.groupBy("split").agg(of("paths").alias("paths_f1"), of("shape").alias("shape_f1"),
                                      of("fusion").alias("fusion_f1"))
    gain = F.col("fusion_f1") - F.col("paths_f1")
    return table.withColumn("gain", gain).withColumn("verdict", metrics.fusion_verdict(gain))


def explanation(samples: DataFrame, nodes: DataFrame, fit: Callable, max_features: int = 2000, min_df: int = 5,
                top: int = 20, per_side: int = 15, per_language: int = 5) -> DataFrame:
    """Importance, direction by class, and direction per language, as one report.

    (section, language, side, rank, term, score)
    """
    documents = reused(path_tokens(nodes, samples.select(*KEEP, "label")))  # trees are built once for all three sections
    rows, names = weighed_paths(documents, max_features, min_df)
    importances = importance_rows(fit(of_split(rows, "train")), names, rows)
    train = of_split(documents, "train")
    weights = reused(tfidf(train, train, F.col("paths"), min_df, max_features, keep=["label", "language"]))
    overall = class_means(weights, train).join(importances, "term").select(
        "term", (F.col("importance") * F.col("difference")).alias("score"))
    by_language = class_means(weights, train, by=["language"]).select(
        "language", "term", F.col("difference").alias("score"))

    def section(df: DataFrame, name: str) -> DataFrame:
        for column in ("language", "side"):
            if column not in df.columns:
                df = df.withColumn(column, F.lit("all"))
        return df.select(F.lit(name).alias("section"), "language", "side", "rank", "term", "score")

    return union_all([
        section(ranked(importances.withColumnRenamed("importance", "score"), "score", top), "importance"),
        section(two_sided(overall, "score", per_side), "direction"),
        section(two_sided(by_language, "score", per_language, ["language"]), "per language"),
    ])

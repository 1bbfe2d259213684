"""Vocabularies and TF-IDF weights as long tables.

A sample's tokens are an array column, so everything that concerns one sample is a
row-wise expression. Only terms cross the network: once, added up per partition,
for the vocabulary, and once, limited to the vocabulary, for the weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylograin.operators.joins import bounded
from stylograin.operators.ordering import join_groups, row_index
from stylograin.session import reused


def token_rows(df: DataFrame, tokens: Column, key: str = "sample_id") -> DataFrame:
    """One row per token: (key, pos, term)."""
    return df.select(key, F.posexplode(tokens).alias("pos", "term"))


def term_totals(df: DataFrame, tokens: Column) -> DataFrame:
    """(term, tf, df): occurrences and samples per term, with a single shuffle.

    Every sample emits its tokens followed by its distinct tokens; the position tells
    the two apart. Both counts are added up inside a partition before the shuffle. (One row
    per distinct term, from runs of sorted tokens, is fewer rows, but finding the runs by
    array functions took 3.7 times as long on character n-grams.)
    """
    arrays = df.select(tokens.alias("tokens"))
    both = arrays.select(F.size("tokens").alias("n"),
                         F.posexplode(F.concat("tokens", F.array_distinct("tokens"))).alias("pos", "term"))
    return both.groupBy("term").agg(F.count_if(F.col("pos") < F.col("n")).alias("tf"),
                                    F.count_if(F.col("pos") >= F.col("n")).alias("df"))


def vocabulary(df: DataFrame, tokens: Column, min_df: int = 1,
               max_features: int | None = None) -> DataFrame:
    """Terms in at least ``min_df`` samples, then the most frequent ones (ties by term)."""
    return limit_vocabulary(term_totals(df, tokens), min_df, max_features)


def limit_vocabulary(totals: DataFrame, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """Terms in at least ``min_df`` samples, cut to the ``max_features`` most frequent (ties by term).

    The count at the cut is found in a histogram with one row per distinct count. All terms
    above it are in; only those with that very count are ranked, in many tasks.
    """
    kept = totals.where(F.col("df") >= min_df)
    if max_features is None:
        return kept
    kept = reused(kept)
    sizes = kept.groupBy("tf").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("tf")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    over = sizes.select("tf", "n", upto.alias("upto")).where(F.col("upto") > max_features)
    cut = over.orderBy(F.desc("tf")).limit(1).first()
    if cut is None:
        return kept
    above, places = kept.where(F.col("tf") > cut.tf), max_features - (cut.upto - cut.n)
    # The first bytes of a term as a number pick its bucket; inside a bucket terms are compared.
    code = F.conv(F.rpad(F.hex(F.substring(F.encode("term", "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    ties = row_index(kept.where(F.col("tf") == cut.tf).withColumn("_code", code), ["_code", "term"], name="_place")
    return above.unionByName(ties.where(F.col("_place") <= places).select(*kept.columns)) if places else above


def with_idf(vocab: DataFrame, fitted_on: DataFrame) -> DataFrame:
    """Smooth inverse document frequency, ``ln((1 + N) / (1 + df)) + 1``."""
    n = fitted_on.agg(F.count(F.lit(1))).scalar()
    return vocab.withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)


def counts_in_vocabulary(df: DataFrame, tokens: Column, vocab: DataFrame,
                         max_features: int | None = None, key: str = "sample_id",
                         keep: Sequence[str] = ()) -> DataFrame:
    """(key, term, vocabulary columns, tf); unknown terms drop out before they are counted."""
    rows = df.select(key, *keep, F.explode(tokens).alias("term"))
    known = rows.join(bounded(vocab, max_features), "term")
    others = [c for c in vocab.columns if c not in ("term", "tf", "df")]
    return known.groupBy(key, "term", *keep, *others).agg(F.count(F.lit(1)).alias("tf"))


def term_weight(sublinear: bool = False) -> Column:
    tf = F.col("tf").cast("double")
    return (F.log(tf) + 1.0 if sublinear else tf) * F.col("idf")


def normalised(weights: DataFrame, key: str = "sample_id", weight: str = "weight") -> DataFrame:
    """Divide by the Euclidean norm of the sample."""
    squares = F.sum(F.col(weight) * F.col(weight)).over(Window.partitionBy(key))
    return weights.withColumn(weight, F.col(weight) / F.sqrt(squares))


def tfidf(train: DataFrame, apply_to: DataFrame, tokens: Column, min_df: int = 1,
          max_features: int | None = None, sublinear: bool = False, key: str = "sample_id",
          keep: Sequence[str] = ()) -> DataFrame:
    """Fit on ``train``, weigh ``apply_to``: long table (key, term, tf, weight)."""
    vocab = with_idf(vocabulary(train, tokens, min_df, max_features), train)
    counted = counts_in_vocabulary(apply_to, tokens, vocab, max_features, key, keep)
    weighed = counted.withColumn("weight", term_weight(sublinear))
    return normalised(weighed, key).select(key, *keep, "term", "tf", "weight")


def coverage_by_language(train: DataFrame, apply_to: DataFrame, tokens: Column, max_features: int,
                         key: str = "sample_id", language: str = "language") -> DataFrame:
    """Mean share of the vocabulary that a sample uses, per language.

    The distinct tokens of a sample are found in its row. Summing hits and samples per
    language is enough, so no table of samples is built; a sample without any hit still
    counts below the line.
    """
    vocab = vocabulary(train, tokens, 1, max_features)
    vocab = reused(vocab.select("term"))
    size = vocab.agg(F.count(F.lit(1))).scalar()
    rows = apply_to.select(language, F.explode(F.array_distinct(tokens)).alias("term"))
    hits = rows.join(bounded(vocab, max_features), "term").groupBy(language).agg(
        F.count(F.lit(1)).alias("hits"))
    samples = apply_to.groupBy(language).agg(F.count(F.lit(1)).alias("n"))
    share = F.coalesce(F.col("hits"), F.lit(0)) / (F.col("n") * size)
    return join_groups(samples, hits, [language], "left").select(
        language, "n", share.alias("coverage")).orderBy(F.desc("coverage"), language)


def class_means(weights: DataFrame, samples: DataFrame, label: str = "label",
                by: Sequence[str] = ()) -> DataFrame:
    """Mean weight per class and term, absent terms counting 0, and the difference.

    ``weights`` carries ``label`` and ``by``; ``samples`` gives the class sizes. Groups
    that hold one class only are left out.
    """
    by = list(by)
    sums = weights.groupBy(*by, "term").agg(
        F.sum(F.when(F.col(label) == 0, F.col("weight")).otherwise(0.0)).alias("s0"),
        F.sum(F.when(F.col(label) == 1, F.col("weight")).otherwise(0.0)).alias("s1"))
    sizes = samples.groupBy(*by).agg(F.count_if(F.col(label) == 0).alias("n0"),
                                     F.count_if(F.col(label) == 1).alias("n1"))
    if by:
        placed = join_groups(sums, sizes.where((F.col("n0") > 0) & (F.col("n1") > 0)), by)
    else:
        placed = sums.withColumns({n: sizes.select(n).scalar() for n in ("n0", "n1")})
    human, machine = F.try_divide("s0", "n0"), F.try_divide("s1", "n1")
    return placed.select(*by, "term", human.alias("mean_human"), machine.alias("mean_machine"),
                         (machine - human).alias("difference"))

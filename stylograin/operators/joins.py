"""Joins between splits, vocabularies and maps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylograin.functions.labels import lookup
from stylograin.operators.profile import text_digest
from stylograin.session import broadcast_if_small

# A side is only hinted for broadcast when a parameter bounds its rows (vocabulary size) to
# no more than this, and the table has been found to keep to it.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int | None) -> DataFrame:
    """Hint a broadcast of a table that is meant to have at most ``rows`` rows, if it has.

    The table is counted up to the bound, and kept for the join; without a bound, or beyond
    it, the join is left to Spark.
    """
    return broadcast_if_small(df, rows) if rows is not None and rows <= BROADCAST_ROWS else df


def leaked_rows(right: DataFrame, left: DataFrame, text: str) -> DataFrame:
    """Count rows of ``right`` whose text occurs in ``left``.

    Both sides are reduced to one row per text digest first: a text copied a billion
    times is one row in the shuffle.
    """
    copies = right.groupBy(text_digest(F.col(text)).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    known = left.select(text_digest(F.col(text)).alias("digest")).distinct()
    marked = copies.join(known.withColumn("hit", F.lit(1)), "digest", "left")
    return marked.agg(F.sum("n").alias("n_rows"),
                      F.coalesce(F.sum(F.col("n") * F.col("hit")), F.lit(0)).alias("n_leaked"))


def aligned_shares(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Union of the keys with the percentage in either table, 0 where a side lacks the key."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        total = counts.agg(F.sum("n")).scalar()
        return counts.select(key, (100.0 * F.col("n") / total).alias(name))

    # A null key is a key like any other, and is found on either side.
    sides = shares(a, "pct_a").unionByName(shares(b, "pct_b"), allowMissingColumns=True)
    both = sides.groupBy(key).agg(F.max("pct_a").alias("pct_a"), F.max("pct_b").alias("pct_b"))
    return both.select(key, F.coalesce("pct_a", F.lit(0.0)).alias("pct_a"),
                       F.coalesce("pct_b", F.lit(0.0)).alias("pct_b"))


def vocabulary_overlap(a: DataFrame, b: DataFrame, term: str = "term") -> DataFrame:
    """Shared terms and their share of the first vocabulary, from one aggregate."""
    sides = a.select(term, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(term, F.lit(0).alias("a"), F.lit(1).alias("b")))
    terms = sides.groupBy(term).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    both = F.count_if((F.col("a") == 1) & (F.col("b") == 1))
    return terms.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), both.alias("n_shared"),
                     (both / F.sum("a")).alias("share_of_a"))


def mapped_ends(edges: DataFrame, mapping: Mapping[str, str], parent: str = "parent_type",
                child: str = "type") -> DataFrame:
    """Both ends of an edge through a small fixed map; unmapped names stay."""
    def through(column: str) -> Column:
        return lookup(F.col(column), mapping)

    return edges.withColumns({parent: through(parent), child: through(child)})


def attach_predictions(samples: DataFrame, predictions: DataFrame, key: str = "sample_id",
                       label: str = "label") -> DataFrame:
    """Join predictions by key and add ``correct``.

    Fails if a sample has no prediction, a prediction no sample, or a key two predictions.
    """
    others = [c for c in predictions.columns if c != key]
    per_key = predictions.groupBy(F.col(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_times"), *[F.first(c).alias(c) for c in others])
    joined = samples.withColumn("_sample", F.lit(True)).join(per_key, F.col(key).eqNullSafe(F.col("_key")), "full_outer")
    fault = (F.when(F.col("_sample").isNull(), F.lit("prediction without a sample: "))
             .when(F.col("_times").isNull(), F.lit("sample without a prediction: "))
             .when(F.col("_times") > 1, F.lit("several predictions for: ")))
    name = F.coalesce(F.col(key), F.col("_key")).cast("string")
    pred = F.when(fault.isNull(), F.col("pred")).otherwise(
        F.raise_error(F.concat(fault, F.coalesce(name, F.lit("null")))).cast("int"))
    return (joined.withColumn("pred", pred).where(fault.isNull() | F.col("pred").isNotNull())
            .withColumn("correct", (F.col("pred") == F.col(label)).cast("int"))
            .select(*samples.columns, *others, "correct"))

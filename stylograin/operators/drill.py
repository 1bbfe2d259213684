"""Drill-down by producer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylograin.functions.labels import GENERATOR_FAMILIES, lookup
from stylograin.functions.text import word_count
from stylograin.operators.profile import all_values, listed


def machine_rows(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label) == 1)


def detection_by_generator(df: DataFrame, generator: str = "generator", language: str = "language",
                           label: str = "label") -> DataFrame:
    """Machine rows per generator: n, detection rate, sorted distinct languages.

    Counts per (generator, language) come first, so the list is built from one row
    per language.
    """
    cells = machine_rows(df, label).groupBy(generator, language).agg(
        F.count(F.lit(1)).alias("n"), F.sum("correct").alias("hits"))
    return cells.groupBy(generator).agg(
        F.sum("n").alias("n_samples"), (F.sum("hits") / F.sum("n")).alias("detection_rate"),
        F.array_join(F.sort_array(F.collect_list(language)), ", ").alias("languages"),
    ).orderBy("detection_rate", generator)


def detected_by_generator(df: DataFrame, at_least: int = 3, generator: str = "generator",
                          language: str = "language", label: str = "label") -> DataFrame:
    """Detected count, rate and most common language (the smallest on ties)."""
    cells = machine_rows(df, label).groupBy(generator, language).agg(
        F.count(F.lit(1)).alias("n"), F.sum("correct").alias("hits"))
    mode = F.min(F.struct((-F.col("n")).alias("n"), F.col(language).alias("language")))
    return cells.groupBy(generator).agg(
        F.sum("n").alias("total"), F.sum("hits").alias("detected"),
        (F.sum("hits") / F.sum("n")).alias("detection_rate"), mode.getField("language").alias("main_language"),
    ).where(F.col("total") >= at_least).orderBy(F.desc("detection_rate"), generator)


def detection_by_family(df: DataFrame, families: Mapping[str, str] = GENERATOR_FAMILIES,
                        at_least: int = 2, generator: str = "generator", label: str = "label") -> DataFrame:
    family = lookup(F.col(generator), families, "Other")
    return machine_rows(df, label).groupBy(family.alias("family")).agg(
        F.count(F.lit(1)).alias("total"), F.sum("correct").alias("detected"),
        F.avg("correct").alias("detection_rate"),
    ).where(F.col("total") >= at_least).orderBy("detection_rate", "family")


def length_by_generator(df: DataFrame, at_least: int = 3, length: Column | None = None,
                        generator: str = "generator", label: str = "label") -> DataFrame:
    """Mean length against detection rate; ``length`` defaults to the words of ``code``."""
    length = word_count(F.col("code")) if length is None else length
    return machine_rows(df, label).groupBy(generator).agg(
        F.avg(length).alias("mean_length"), F.avg("correct").alias("detection_rate"),
        F.count(F.lit(1)).alias("total")).where(F.col("total") >= at_least)


def generator_language_matrix(df: DataFrame, languages: Sequence[str] | None = None, at_least: int = 3,
                              generator: str = "generator", language: str = "language",
                              label: str = "label") -> DataFrame:
    """Detection rate per generator and language (0 where empty) with the cell sizes.

    A row in a language outside the list (or null) is an error, as the minimum support is
    about all rows; without a list the languages are those that occur.
    """
    rows = machine_rows(df, label)
    languages = all_values(rows, language) if languages is None else languages
    table = rows.withColumn(language, listed(F.col(language), languages)).groupBy(generator).pivot(language, list(languages)).agg(
        F.avg("correct").alias("rate"), F.count(F.lit(1)).alias("n"))
    rates = [F.coalesce(F.col(f"`{v}_rate`"), F.lit(0.0)).alias(f"rate_{v}") for v in languages]
    sizes = [F.coalesce(F.col(f"`{v}_n`"), F.lit(0)).alias(f"n_{v}") for v in languages]
    total = sum((F.coalesce(F.col(f"`{v}_n`"), F.lit(0)) for v in languages), F.lit(0))
    return table.where(total >= at_least).select(generator, *rates, *sizes)


def extremes(stats: DataFrame, generator: str = "generator") -> DataFrame:
    """Hardest and easiest generator, how many are above and below one half, total rows."""
    row = F.struct(F.col("detection_rate").alias("rate"), F.col(generator).alias("name"))
    return stats.agg(
        F.sum("n_samples").alias("n_machine"), F.count(F.lit(1)).alias("n_generators"),
        F.count_if(F.col("detection_rate") >= 0.5).alias("n_easy"),
        F.count_if(F.col("detection_rate") < 0.5).alias("n_hard"),
        F.min(row).alias("h"), F.max(row).alias("e"),
    ).select("n_machine", "n_generators", "n_easy", "n_hard",
             F.col("h.name").alias("hardest"), F.col("h.rate").alias("hardest_rate"),
             F.col("e.name").alias("easiest"), F.col("e.rate").alias("easiest_rate"))


def example_rows(df: DataFrame, stats: DataFrame, key: str = "sample_id",
                 generator: str = "generator", label: str = "label") -> DataFrame:
    """First missed row of the hardest and first detected row of the easiest generator."""
    ends = extremes(stats, generator)
    hardest, easiest = ends.select("hardest").scalar(), ends.select("easiest").scalar()
    machine = machine_rows(df, label)
    hard = machine.where((F.col(generator) == hardest) & (F.col("correct") == 0))
    easy = machine.where((F.col(generator) == easiest) & (F.col("correct") == 1))
    return (hard.orderBy(key).limit(1).withColumn("case", F.lit("hardest missed"))
            .unionByName(easy.orderBy(key).limit(1).withColumn("case", F.lit("easiest detected"))))

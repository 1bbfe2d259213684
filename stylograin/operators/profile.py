"""Profiling aggregates: counts, shares, lengths, duplicates, crosstabs, histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylograin.operators.ordering import join_groups, quantiles, value_counts_of
from stylograin.session import reused


def value_counts(df: DataFrame, *by: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *by)


def value_shares(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and share per value, within ``by`` if given."""
    by = list(by)
    counts = reused(df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    if by:
        counts = join_groups(counts, totals, by)
        return counts.withColumn("share", F.col("n") / F.col("_total")).drop("_total")
    return counts.withColumn("share", F.col("n") / totals.scalar())


def mean_by(df: DataFrame, value: Column, *by: str, name: str = "mean_value") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias(name))


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles, max."""
    stats = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    quarts = quantiles(df, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by)
    if by:
        return join_groups(stats, quarts, by, "left")
    # One row on either side.
    one = quarts.select(F.struct("q25", "q50", "q75")).scalar()
    return stats.withColumn("_q", one).select("*", "_q.*").drop("_q")


def text_digest(text: Column) -> Column:
    """What stands for a text in shuffles: 32 bytes, whatever the length of the text."""
    return F.unhex(F.sha2(text, 256))


def duplicate_count(df: DataFrame, text: str) -> DataFrame:
    """Rows that equal an earlier row."""
    copies = df.groupBy(text_digest(F.col(text)).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_duplicates"))


def all_values(df: DataFrame, column: str, most: int = 1000) -> list:
    """The distinct values of a column, in order, without null; a table cannot have more than ``most`` columns for them."""
    found = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(found)


def listed(column: Column, values: Sequence) -> Column:
    """``column``, or an error where it has a value (or null) that is not in the list: a table by list must not lose rows."""
    message = F.concat(F.lit("value not listed: "), F.coalesce(column.cast("string"), F.lit("null")))
    return F.when(column.isin(list(values)), column).otherwise(F.raise_error(message))


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence | None = None) -> DataFrame:
    """Counts per row value and column value, 0 where there are none.

    Columns are the given values, and a row with another one (or null) is an error; without
    a list they are the values that occur, and rows of null are left to ``n_null``, which
    is there if there are any.
    """
    if values is None:
        values = all_values(df, columns)
        if not df.where(F.col(columns).isNull()).isEmpty():
            df, values = df.withColumn(columns, F.coalesce(F.col(columns).cast("string"), F.lit("null"))), [*map(str, values), "null"]
    table = df.withColumn(columns, listed(F.col(columns), values)).groupBy(rows).pivot(columns, list(values)).count()
    return table.select(rows, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(f"n_{v}") for v in values])


def crosstab_percent(df: DataFrame, rows: str, columns: str, values: Sequence | None = None) -> DataFrame:
    """Crosstab in percent of each row."""
    table = crosstab(df, rows, columns, values)
    names = [c for c in table.columns if c != rows]
    whole = sum((F.col(f"`{n}`") for n in names), F.lit(0))
    return table.select(rows, *[(100.0 * F.col(f"`{n}`") / whole).alias(f"pct_{n[2:]}") for n in names])


def class_prior(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Machine share, human / machine ratio, and (1 - p) / p."""
    p = F.avg(F.col(label).cast("double"))
    machine, human = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.where(F.col(label).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), machine.alias("n_machine"), human.alias("n_human"),
        p.alias("machine_share"), F.try_divide(human, machine).alias("human_per_machine"),
        F.try_divide(1 - p, p).alias("odds_against"))


def class_summary(df: DataFrame, value: str, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
                                 F.stddev_pop(value).alias("std"))


def density_histogram(df: DataFrame, value: str, bins: int = 40, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over each group's own range; the last bin holds its right edge.

    Empty bins are kept, as a plot shows them. A group of one single value gets the
    unit range around it.
    """
    by = list(by)
    # Equal values are counted first: all that follows works on distinct values.
    counts = reused(value_counts_of(df.withColumn("_x", F.col(value).cast("double")), "_x", by))
    ranges = counts.groupBy(*by).agg(F.min("_x").alias("low"), F.max("_x").alias("high"),
                                     F.sum("n").alias("total"))
    flat = F.col("low") == F.col("high")
    ranges = ranges.select(*by, "total",
                           F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
                           F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"))
    if by:
        placed = join_groups(counts, ranges, by)
    else:
        one = ranges.select(F.struct("low", "high", "total").alias("r")).scalar()
        placed = counts.withColumn("_r", one).select("_x", "n", "_r.low", "_r.high", "_r.total")
    place = F.floor((F.col("_x") - F.col("low")) / (F.col("high") - F.col("low")) * bins)
    hits = placed.groupBy(*by, F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.sum("n").alias("n"))
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("high") - F.col("low")) / bins
    full = join_groups(grid, hits, [*by, "bin"], "left")
    n = F.coalesce("n", F.lit(0))
    return full.select(*by, "bin", (F.col("low") + F.col("bin") * width).alias("bin_low"),
                       n.alias("n"), (n / (F.col("total") * width)).alias("density"))


def box_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers at most 1.5 quartile ranges long, and the number of outliers."""
    by = list(by)
    counts = reused(value_counts_of(df, value, by)).withColumnRenamed("n", "_n")
    boxes = quantiles(df, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by)
    if by:
        joined = join_groups(counts, boxes, by)
    else:
        one = boxes.select(F.struct("q25", "q50", "q75").alias("b")).scalar()
        joined = counts.withColumn("_b", one).select("*", "_b.*")
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = F.col(value).between(F.col("q25") - reach, F.col("q75") + reach)
    return joined.groupBy(*by).agg(
        F.first("q25").alias("q25"), F.first("q50").alias("q50"), F.first("q75").alias("q75"),
        F.min(F.when(inside & (F.col(value) <= F.col("q25")), F.col(value))).alias("_lo"),
        F.max(F.when(inside & (F.col(value) >= F.col("q75")), F.col(value))).alias("_hi"),
        F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("n_outliers"),
    ).select(*by, "q25", "q50", "q75",
             F.coalesce(F.col("_lo").cast("double"), F.col("q25")).alias("whisker_low"),
             F.coalesce(F.col("_hi").cast("double"), F.col("q75")).alias("whisker_high"),
             "n_outliers")


def correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson correlation of every feature pair, from one aggregate; null for a constant."""
    pairs = list(combinations(features, 2))
    wide = df.agg(*[F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"c{i}")
                    for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                              F.col(f"c{i}").alias("correlation"))
                     for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(rows))


def length_profile(df: DataFrame, tokens: Column) -> DataFrame:
    return df.select(F.size(tokens).alias("_n")).agg(
        F.min("_n").alias("min_tokens"), F.max("_n").alias("max_tokens"),
        F.avg("_n").alias("mean_tokens"))


def coverage(df: DataFrame, count: Column) -> DataFrame:
    """Mean of an optional feature, and how many rows lack it."""
    return df.agg(F.avg(count).alias("mean_count"), F.count_if(count == 0).alias("n_without"),
                  (100.0 * F.count_if(count == 0) / F.count(F.lit(1))).alias("pct_without"))


def standardised(df: DataFrame, features: Sequence[str], fit_on: DataFrame | None = None,
                 centre: bool = True) -> DataFrame:
    """``(x - mean) / std`` with the population deviation of ``fit_on``; a constant stays unscaled."""
    fit_on = df if fit_on is None else fit_on
    stats = fit_on.agg(F.struct(
        *[F.avg(f).alias(f"m_{f}") for f in features],
        *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).alias("stats"))
    out = df.withColumn("_stats", stats.scalar())

    def scaled(f: str) -> Column:
        spread = F.col(f"_stats.s_{f}")
        shifted = F.col(f) - F.col(f"_stats.m_{f}") if centre else F.col(f)
        return shifted / F.when(spread > 0, spread).otherwise(1.0)

    return out.withColumns({f: scaled(f) for f in features}).drop("_stats")


def standard_scales(df: DataFrame, features: Sequence[str]) -> Mapping[str, tuple[float, float]]:
    """Mean and population deviation per feature, for models that keep their scaling."""
    row = df.agg(*[F.avg(f).alias(f"m_{f}") for f in features],
                 *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    return {f: (row[f"m_{f}"] or 0.0, row[f"s_{f}"] or 1.0) for f in features}

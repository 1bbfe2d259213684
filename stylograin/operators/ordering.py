"""Ranks, prefix sums and quantiles that never pull a whole group into one task.

A window over a hot group (or over no group at all) sorts the group in one task.
Every function here first cuts the order into buckets, adds up the buckets, and
then runs the window inside (group, bucket) only. The bucket of a row depends on
its order key and on constant cut points, so a recomputed task gives the same result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylograin.session import broadcast_if_small, reused


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group columns of which any may be null: null is a group like any other."""
    renamed = {name: f"_right_{name}" for name in by}
    condition = reduce(Column.__and__, [F.col(name).eqNullSafe(F.col(other)) for name, other in renamed.items()])
    return left.join(right.withColumnsRenamed(renamed), condition, how).drop(*renamed.values())


def bucket_count(df: DataFrame) -> int:
    """As many buckets as shuffle partitions, the number that a cluster is set up to work through."""
    return max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_quantile_bucket(df: DataFrame, order: str, buckets: int | None = None,
                         name: str = "_bucket") -> DataFrame:
    """Add the number of approximate quantiles of ``order`` that do not exceed its value.

    The cut points are fetched once, fewer numbers than buckets, and become constants of
    the plan, in which each row's place is found by binary search. Approximate quantiles may differ between two runs; as constants they are the
    same for the bucket sums and for the rows. They only steer the partitioning, results
    do not depend on them.
    """
    buckets = buckets or bucket_count(df)
    shares = [i / buckets for i in range(1, buckets)]
    value = F.col(order).cast("double")
    found = df.agg(F.percentile_approx(value, shares, 2000)).first()[0] or []
    cuts = sorted({cut for cut in found if math.isfinite(cut)})
    if not cuts:
        return df.withColumn(name, F.lit(0))
    search = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_order", outputCol="_found", handleInvalid="keep")
    # Nulls come first. Never null: otherwise a join on the bucket pushes a null test down to the source.
    placed = search.transform(df.withColumn("_order", F.coalesce(value, F.lit(-math.inf))))
    return placed.withColumn(name, F.coalesce(F.col("_found").cast("int"), F.lit(0))).drop("_order", "_found")


def prefix_sums(df: DataFrame, order: Sequence[str], values: Mapping[str, Column],
                by: Sequence[str] = (), bucket: Column | None = None,
                buckets: int | None = None) -> DataFrame:
    """Add ``<name>_upto`` (running sum, row included) and ``<name>_all`` (group sum).

    ``order`` must identify the rows of a group. Its first column picks the bucket
    unless ``bucket`` is given, and must then be numeric.
    """
    by = list(by)
    rows = (with_quantile_bucket(df, order[0], buckets) if bucket is None
            else df.withColumn("_bucket", bucket))
    rows = rows.withColumns({f"_v_{n}": v for n, v in values.items()})
    totals = rows.groupBy(*by, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = totals.select(
        *by, "_bucket",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in values],
        *[F.sum(f"_t_{n}").over(whole).alias(f"{n}_all") for n in values],
    )
    if not by and bucket is None:
        # One row per bucket, and the buckets are as many as was asked for.
        offsets = F.broadcast(offsets)
    inside = (Window.partitionBy(*by, "_bucket").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = join_groups(rows, offsets, [*by, "_bucket"])
    out = joined.withColumns({f"{n}_upto": F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(inside)
                              for n in values})
    return out.drop("_bucket", *[f"_v_{n}" for n in values], *[f"_o_{n}" for n in values])


def row_index(df: DataFrame, order: Sequence[str], by: Sequence[str] = (),
              bucket: Column | None = None, name: str = "row_no") -> DataFrame:
    """Number the rows 1, 2, … in ``order`` (per group), and give the group size.

    Adds ``row_no`` and ``row_no_all``.
    """
    counted = prefix_sums(df, order, {name: F.lit(1).cast("bigint")}, by, bucket)
    return counted.withColumnRenamed(f"{name}_upto", name)


def hash_key(id_col: str, seed: int) -> Column:
    """A reproducible random order key: md5 of ``id:seed``, then the id against ties."""
    key = F.col(id_col).cast("string")
    return F.concat(F.md5(F.concat(key, F.lit(f":{seed}"))), key)


def random_cutoffs(df: DataFrame, id_col: str, seed: int, quotas: Mapping[str, Column],
                   by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Per group, the order key of the last row of each quota in random order.

    ``quotas`` are expressions over ``size``, the group's row count, and ``total``, the count
    of all rows. A row belongs to a
    quota exactly if its order key is not above the cutoff, so samples and splits are
    plain filters and texts never move. Only keys are read; after counting them per
    (group, first digits of the hash), only the buckets that hold a cutoff are ranked.
    There are as many digits as give each shuffle partition 16 buckets or more, so that a
    bucket of one group is a small part of what one task is meant to hold. A quota below 1
    gives an empty cutoff, which no key reaches. Null groups are groups.
    """
    by = list(by)
    digits = digits or max(3, len(f"{16 * bucket_count(df) - 1:x}"))
    keys = df.select(*by, hash_key(id_col, seed).alias("_key"))
    keys = keys.withColumn("_bucket", F.coalesce(F.substring("_key", 1, digits), F.lit("")))
    counts = reused(keys.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"size": F.sum("_n").over(whole), "_upto": F.sum("_n").over(upto),
                                 "total": counts.agg(F.sum("_n")).scalar()})
    wanted = F.inline(F.array(*[F.struct(F.lit(name).alias("_quota"), value.cast("bigint").alias("_row"))
                                for name, value in quotas.items()]))
    marks = placed.select(*by, "_bucket", "_n", "_upto", wanted)
    first = F.col("_upto") - F.col("_n")
    edge = marks.where((F.col("_row") > first) & (F.col("_row") <= F.col("_upto")))
    edge = edge.select(*by, "_bucket", "_quota", (F.col("_row") - first).alias("_place"))
    in_bucket = Window.partitionBy(*by, "_bucket", "_quota").orderBy("_key")
    # One row per group and quota; without groups that is one row per quota.
    edge = broadcast_if_small(edge) if by else F.broadcast(edge)
    ranked = join_groups(keys, edge, [*by, "_bucket"]).withColumn("_rank", F.row_number().over(in_bucket))
    found = ranked.where(F.col("_rank") == F.col("_place"))
    groups = placed.select(*by, "size", "total").distinct()
    cuts = found.groupBy(*by).agg(*[
        F.max(F.when(F.col("_quota") == name, F.col("_key"))).alias(name) for name in quotas])
    if not by:
        return cuts.select(*[F.coalesce(name, F.lit("")).alias(name) for name in quotas])
    return join_groups(groups, cuts, by, "left").select(
        *by, "size", "total", *[F.coalesce(name, F.lit("")).alias(name) for name in quotas])


def with_cutoffs(df: DataFrame, id_col: str, seed: int, quotas: Mapping[str, Column],
                 by: Sequence[str] = ()) -> DataFrame:
    """Add ``_key`` and one cutoff column per quota."""
    cuts = random_cutoffs(df, id_col, seed, quotas, by)
    keyed = df.withColumn("_key", hash_key(id_col, seed))
    if by:
        return join_groups(keyed, broadcast_if_small(cuts.drop("size", "total")), by)
    return keyed.withColumns({name: cuts.select(name).scalar() for name in quotas})


def value_counts_of(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, n) without nulls.

    The nulls go after the count: a filter on ``value`` itself would be pushed below the
    aggregate and compute the value twice.
    """
    counts = df.groupBy(*by, value).agg(F.count(value).alias("n"))
    return counts.where(F.col("n") > 0)


def quantiles(df: DataFrame, value: str, shares: Mapping[str, float],
              by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per share.

    Equal values are counted before anything is ordered, so a hot value is one row.
    """
    by = list(by)
    counts = reused(value_counts_of(df, value, by))
    ranked = prefix_sums(counts, [value], {"n": F.col("n")}, by)
    first, last = F.col("n_upto") - F.col("n"), F.col("n_upto") - 1

    def at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position <= last), F.col(value).cast("double")))

    columns = []
    for name, share in shares.items():
        place = (F.col("n_all") - 1) * F.lit(float(share))
        low, high = F.floor(place), F.ceil(place)
        fraction = F.max(place - low)
        columns.append((at(low) + (at(high) - at(low)) * fraction).alias(name))
    return ranked.groupBy(*by).agg(*columns)


def _spread(df: DataFrame, order: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """Rows dealt out by ranges of (group, order), with the number of their range."""
    shares = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(shares, *by, *order).withColumn("_range", F.spark_partition_id())


def numbered_in_ranges(df: DataFrame, order: Sequence[Column], by: Sequence[str], most: int, name: str) -> DataFrame:
    """The first ``most`` rows of each group with their number in ``order``, which may hold hot values and any types.

    Rows are dealt out by ranges of (group, order), and kept, so that a row has one range. What earlier ranges
    hold of a group is added up from one row per (group, range). Ranges that begin beyond ``most`` are not sorted.
    """
    ranged = reused(_spread(df, order, by))
    sizes = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.withColumn("_begin", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where(F.col("_begin") < most).drop("_n")
    if not by:
        begins = F.broadcast(begins)  # one row per range
    inside = Window.partitionBy(*by, "_range").orderBy(*order)
    rows = join_groups(ranged, begins, [*by, "_range"])
    number = (F.col("_begin") + F.row_number().over(inside)).cast("int" if most < 1 << 31 else "bigint")
    return rows.withColumn(name, number).where(F.col(name) <= most).drop("_range", "_begin")


def top_per_group(df: DataFrame, k: int, value: str, tie: str, by: Sequence[str] = (), descending: bool = True,
                  name: str = "rank") -> DataFrame:
    """The ``k`` rows of largest (or least) ``value`` per group, or of all rows, with their rank; the least ``tie`` goes first.

    The k-th value is closed in on by counts: rows are counted per (group, quantile bucket of the value), and a
    bucket that begins beyond the k-th row is dropped before any row moves. What is left, ``k`` rows and the rest of
    one bucket per group, is numbered in ranges. So the largest task holds a share of that, for any ``k``. Nulls
    are below all values, and NaN is above them.
    """
    by = list(by)
    placed = with_quantile_bucket(df, value)
    counts = placed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    order = F.desc("_bucket") if descending else F.asc("_bucket")
    earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    wanted = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where(F.col("_before") < k)
    wanted = wanted.select(*by, "_bucket")
    if not by:
        wanted = F.broadcast(wanted)  # one row per bucket
    left = join_groups(placed, wanted, [*by, "_bucket"], "left_semi").drop("_bucket")
    return numbered_in_ranges(left, [F.desc(value) if descending else F.asc(value), F.asc(tie)], by, k, name)

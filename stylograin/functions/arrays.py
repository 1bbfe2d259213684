"""Native expressions on id arrays and score arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylograin.functions.text import once


def head(ids: Column, limit: int = 512) -> Column:
    return F.slice(ids, 1, limit)


def head_and_tail(ids: Column, first: Column, last: Column, limit: int = 512) -> Column:
    """Markers around the ids; a long list keeps its first and last halves."""
    room = limit - 2
    half = room // 2
    whole = F.concat(F.array(first), ids, F.array(last))
    tail = F.slice(ids, F.greatest(F.size(ids) - half + 1, F.lit(1)), F.lit(half))
    cut = F.concat(F.array(first), F.slice(ids, 1, half), tail, F.array(last))
    return F.when(F.size(ids) <= room, whole).otherwise(cut)


def padded(ids: Column, length: Column, filler: Column) -> Column:
    return F.concat(ids, F.array_repeat(filler, F.greatest(length - F.size(ids), F.lit(0))))


def attention_mask(ids: Column, length: Column) -> Column:
    missing = F.greatest(length - F.size(ids), F.lit(0))
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), missing))


def padded_to_batch(df: DataFrame, batch: str, ids: str, filler: Column) -> DataFrame:
    """Pad every list to the longest of its batch and add ``mask``; a batch is small by design."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    return (df.withColumn("batch_length", longest)
            .withColumn("mask", attention_mask(F.col(ids), F.col("batch_length")))
            .withColumn(ids, padded(F.col(ids), F.col("batch_length"), filler)))


def two_segments(first: Column, second: Column, start: Column, separator: Column,
                 limit: int = 512) -> Column:
    """``start + first + separator + second + separator``; ``first`` gives way to ``second``."""
    room = F.greatest(F.lit(limit - 3) - F.size(second), F.lit(0))
    return F.concat(F.array(start), F.slice(first, F.lit(1), room), F.array(separator),
                    second, F.array(separator))


def positions(ids: Column) -> Column:
    """0 … n-1."""
    return F.when(F.size(ids) > 0, F.sequence(F.lit(0), F.size(ids) - 1)).otherwise(
        F.array().cast("array<int>"))


def clamped_positions(indices: Column, length: Column, start: int = 1) -> Column:
    """Index in a list of ``length`` items, too large ones moved to the last, shifted by ``start``."""
    return once(length - 1, lambda last: F.transform(
        indices, lambda i: F.lit(start) + F.least(i, last)))


def first_distinct(items: Column, limit: int = 64) -> Column:
    """First occurrences in order, at most ``limit``."""
    return F.slice(F.array_distinct(items), 1, limit)


def argmax(scores: Column) -> Column:
    """Zero-based index of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def softmax(scores: Column) -> Column:
    """Shares of exp(score), shifted by the maximum."""
    def shares(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda acc, p: acc + p)
        return once(total, lambda t: F.transform(powers, lambda p: p / t))

    def shifted(wide: Column) -> Column:
        powers = once(F.array_max(wide), lambda top: F.transform(wide, lambda x: F.exp(x - top)))
        return once(powers, shares)

    return once(scores.cast("array<double>"), shifted)


def cross_entropy(scores: Column, label: Column) -> Column:
    """``-ln softmax(scores)[label]`` without building the softmax."""
    def loss(wide: Column, top: Column) -> Column:
        total = F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        return F.log(total) - (F.element_at(wide, label + 1) - top)

    return once(scores.cast("array<double>"),
                lambda wide: once(F.array_max(wide), lambda top: loss(wide, top)))

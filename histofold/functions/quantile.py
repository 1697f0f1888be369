"""Exact quantiles of many groups without gathering a group's values in one task.

``percentile`` keeps the value map of a group in one buffer.  Here the values are counted
by ``(group, value)`` (a hash aggregate with map-side combine), the counts are summed over
*blocks* of values, prefix sums over a group's blocks say which blocks hold the wanted ranks,
and only these are counted through.  A block is 1/1024 of a power of two: a group has some
65,000 blocks of whole numbers up to 2^63 at most, and a block of sizes below 2^30 has at most
2^20 distinct values, so the largest task is bounded by a block however many rows a group has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks between two powers of two.
PER_OCTAVE = 1024


def block(value: Column) -> Column:
    """Block of a finite value, a whole number that never falls as the value grows."""
    v = value.cast("double")
    octave = F.floor(F.log2(F.abs(v)))
    step = F.floor(F.abs(v) / F.pow(F.lit(2.0), octave) * PER_OCTAVE)
    # ``step`` runs from PER_OCTAVE to twice that; an octave that log2 rounds up starts a little below
    place = (octave + 1100) * PER_OCTAVE + step
    return F.when(v == 0, F.lit(0).cast("long")).otherwise(F.when(v > 0, place).otherwise(-place))


def exact_quantiles(values: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float] = (0.5,)) -> DataFrame:
    """``(keys, n, q)``: how many values each group has, and their quantiles ``qs`` as an array of doubles.

    Quantiles interpolate between the two nearest ranks and equal ``percentile``'s.  Null values do not count; a
    group without values has no row; there must be at least one key.
    """
    keys = list(keys)
    counts = (values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v"))
              .agg(F.count(F.lit(1)).alias("__n")).withColumn("__b", block(F.col("__v"))))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy(*keys, "__b").agg(F.sum("__n").alias("__bn"))
    blocks = blocks.select(*keys, "__b", "__bn", F.coalesce(F.sum("__bn").over(before), F.lit(0)).alias("__from"),
                           F.sum("__bn").over(Window.partitionBy(*keys)).alias("__total"))

    def place(q: float) -> Column:
        return (F.col("__total") - 1) * F.lit(float(q))

    def holds(rank: Column, start: str, size: str) -> Column:
        return (rank >= F.col(start)) & (rank < F.col(start) + F.col(size))

    wanted = F.lit(False)
    for q in qs:
        wanted = wanted | holds(F.floor(place(q)), "__from", "__bn") | holds(F.ceil(place(q)), "__from", "__bn")
    picked = blocks.where(wanted).drop("__bn")
    inside = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.join(picked, [*keys, "__b"]).withColumn(
        "__at", F.col("__from") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    v = F.col("__v").cast("double")
    found = ranked.groupBy(*keys, "__total").agg(*[
        F.max(F.when(holds(rank(place(q)), "__at", "__n"), v)).alias(f"__{side}{i}")
        for i, q in enumerate(qs) for side, rank in (("lo", F.floor), ("hi", F.ceil))])

    def between(i: int, q: float) -> Column:
        lo, hi, r = F.col(f"__lo{i}"), F.col(f"__hi{i}"), place(q)
        return F.when(lo == hi, lo).otherwise((F.ceil(r) - r) * lo + (r - F.floor(r)) * hi)

    return found.select(*keys, F.col("__total").alias("n"), F.array(*[between(i, q) for i, q in enumerate(qs)]).alias("q"))

"""Exact medians by counted ranges.

No task gathers a group's values. Equal values are counted first, before any shuffle. In each pass the range that still holds the middle of
a group is divided into parts, the values in each are counted, with the least and greatest of them, and running
counts say in which part the middle lies; that part, from its least to its greatest value, is the next range. A pass moves a row for each group
and part that has values. A range of one value ends a group, as does a middle that falls between two parts: it is then the
mean of the one's greatest value and the other's least.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from panelforge.sources.shared import stored
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 512
#: Groups whose state is broadcast to the values; with more, values and states meet by a shuffle.
GROUPS_SENT = 100_000


def same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)])


def size_of(value: Column) -> Column:
    """The sign and power of two of a value as a whole number, rising with it; infinities and NaN are at the ends."""
    power = F.floor(F.log2(F.when(F.abs(value) < float("inf"), F.abs(value)))) + 1200
    finite = F.when(value == 0, 0).when(value > 0, power).otherwise(-power)
    return F.when(F.isnan(value), 5000).when(value == float("inf"), 4000).when(value == float("-inf"), -4000).otherwise(finite).cast("int")


def part_of(value: Column, low: Column, high: Column) -> Column:
    """The part of the range that a value lies in, rising with the value: by powers of two, or within one of them by equal parts.

    So a range is down to a factor of two after one pass, however the values are spread, and to 1/BUCKETS of itself with each further one.
    """
    inner = F.least(F.floor(F.try_divide(value - low, high - low) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    return F.when(size_of(low) == size_of(high), inner).otherwise(size_of(value))


def medians(rows: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """``keys`` and the exact median ``out`` of ``value`` in each group; NULL for a group that has no value.

    Nulls do not count. NaN counts as greater than all numbers, and a middle between NaN and another value is NaN. Keys may be null, which is
    a group; without keys there is one group, also of an empty table. The mean of two middle values is (a + b) / 2.
    """
    named = [f"k{i}" for i in range(len(keys))]
    plain = rows.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, named, strict=True)], F.col(f"`{value}`").cast("double").alias("v"))
    counted = stored(plain.groupBy(*named, "v").agg(F.count("*").alias("n")), "values")
    ahead = Window.partitionBy(*[f"_{n}" for n in named]).orderBy("part")
    held = counted.where("v is not null")
    state = held.groupBy(*named).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("total")).where("total is not null")
    # The ranks, from 0, of the one or two values in the middle, of those in the range.
    state = state.select(*named, "low", "high", F.floor((F.col("total") - 1) / 2).alias("first"), F.floor(F.col("total") / 2).alias("second"), F.lit(None).cast("double").alias("found"))
    state = stored(_ended(state), "ranges")
    while not state.where("found is null").isEmpty():
        active = state.where("found is null").select(*[F.col(n).alias(f"_{n}") for n in named], "low", "high", "first", "second")
        active = F.broadcast(active) if active.count() <= GROUPS_SENT else active
        inside = F.col("v").between(F.col("low"), F.col("high"))  # NaN is greatest here, too
        matched = same(named, [f"_{n}" for n in named]) & inside if named else inside
        parts = held.join(active, matched).groupBy(*[f"_{n}" for n in named], "low", "high", "first", "second", part_of(F.col("v"), F.col("low"), F.col("high")).alias("part"))
        parts = parts.agg(F.sum("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        # A group has no more rows here than there are parts.
        parts = parts.withColumn("before", F.sum("n").over(ahead) - F.col("n"))
        has = lambda rank: (F.col("before") <= F.col(rank)) & (F.col(rank) < F.col("before") + F.col("n"))
        row = F.struct("least", "most", "before")
        located = parts.groupBy(*[f"_{n}" for n in named]).agg(F.max(F.when(has("first"), row)).alias("one"), F.max(F.when(has("second"), row)).alias("two"))
        split = F.col("one.before") != F.col("two.before")
        joined = state.join(located, same(named, [f"_{n}" for n in named]) if named else F.lit(True), "left")
        new = F.col("one").isNotNull()
        state = joined.select(
            *named, F.when(new, F.col("one.least")).otherwise(F.col("low")).alias("low"), F.when(new, F.col("one.most")).otherwise(F.col("high")).alias("high"),
            *[F.when(new, F.col(c) - F.col("one.before")).otherwise(F.col(c)).alias(c) for c in ("first", "second")],
            F.coalesce("found", F.when(split, (F.col("one.most") + F.col("two.least")) / 2)).alias("found"),
        )
        state = stored(_ended(state), "ranges")
    groups = counted.select(*named).distinct() if named else counted.sparkSession.range(1).select()
    every = groups.select(*[F.col(n).alias(f"_{n}") for n in named]) if named else groups
    done = every.join(state.select(*named, F.col("found").alias(out)), same([f"_{n}" for n in named], named) if named else F.lit(True), "left")
    return done.select(*[F.col(f"_{n}").alias(k) for n, k in zip(named, keys, strict=True)], out)


def _ended(state: DataFrame) -> DataFrame:
    """A range of one value is the median."""
    one = F.col("low") == F.col("high")
    return state.withColumn("found", F.coalesce("found", F.when(one, F.col("low"))))

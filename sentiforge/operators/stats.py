"""Corpus statistics: frequency tables, slices, distinct counts, profiles.

Frequency tables are ``groupBy(value).count()`` (partial hash aggregation,
so a hot value costs one partial row per task).  Ordered slices use a
sort with limit/offset, which Spark plans as a distributed partial top-k.
Profiles stack the profiled columns into one long ``(column, value)`` table
and aggregate it once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentiforge.scratch import written


def freq_table(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """``(col, n)``; order (if needed) is n desc then value asc."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def tail_slice(freq: DataFrame, col: str, start_from_end: int, stop_from_end: int, n_col: str = "n") -> DataFrame:
    """Python ``most_common()[-start:-stop]`` on the (n desc, value asc) order,
    returned in reverse order (least common first)."""
    return (freq.orderBy(F.asc(n_col), F.desc(col))
            .offset(stop_from_end).limit(start_from_end - stop_from_end))


def distinct_and_total(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.count_distinct(col).alias("n_distinct"), F.count(col).alias("n_total"))


def distribution(df: DataFrame, col: str) -> DataFrame:
    """``(col, n, share)``: counts and shares of the whole (share via a scalar subquery)."""
    total = df.select(F.count(F.lit(1))).scalar()
    return freq_table(df, col).withColumn("share", F.col("n") / total)


def profile_strings(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column_name, count, unique, top, freq)`` per string column; ties of the
    top value go to the smallest value."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("s")).select("s.*")
    counts = stacked.where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column_name").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("freq"))


def numeric_profile(df: DataFrame, col: str) -> DataFrame:
    """One-pass profile of a numeric column (exact parts)."""
    c = F.col(col)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(c.isNull()).alias("n_missing"),
                  F.count_distinct(c).alias("n_distinct"), F.min(c).alias("min"), F.max(c).alias("max"),
                  F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                  F.count_if(c == 1).alias("n_ones"))


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float]) -> DataFrame:
    """``(q, value)``: the smallest value with at least ``q`` of all (non-null) values at or below it.

    Equal values are counted first; the distinct ones are dealt to sampled ranges, whose
    totals (one row per range) tell which range holds each rank, and only those ranges are
    searched by a running sum."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    cut = counts.repartitionByRange("value").sortWithinPartitions("value").withColumn("_p", F.spark_partition_id())
    held = written(cut, "quantiles")
    ranges = held.groupBy("_p").agg(F.sum("n").alias("_t"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)   # over one row per range
    ranges = ranges.select("_p", "_t", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    total = held.agg(F.sum("n")).first()[0] or 0
    # k/100 may not be a binary fraction: a rank a hair above a whole number is that number
    ranks = [(float(q), max(1, math.ceil(q * total - 1e-9))) for q in qs]
    want = df.sparkSession.createDataFrame(ranks, "q double, r long")
    found = F.broadcast(want).join(F.broadcast(ranges), (F.col("r") > F.col("_off")) & (F.col("r") <= F.col("_off") + F.col("_t")))
    inside = Window.partitionBy("_p", "q").orderBy("value")
    run = held.join(F.broadcast(found.select("q", "r", "_p", "_off")), "_p").withColumn("_cum", F.col("_off") + F.sum("n").over(inside))
    return run.where((F.col("_cum") >= F.col("r")) & (F.col("_cum") - F.col("n") < F.col("r"))).select("q", "value")


def histogram(df: DataFrame, col: str, low: float, high: float, bins: int) -> DataFrame:
    """``(bin, lower, upper, n)``: equal-width bins of ``low <= value <= high`` (the last one closed), empty bins too."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(col) - low) / width).cast("int"), F.lit(bins - 1))
    counts = df.where((F.col(col) >= low) & (F.col(col) <= high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.lit(low) + F.col("bin") * width).alias("lower"),
                                                    (F.lit(low) + (F.col("bin") + 1) * width).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def extremes(freq: DataFrame, col: str, k: int, n_col: str = "n") -> DataFrame:
    """``(side, rank, value, n)``: the k most and the k least common values (ties: smaller value first, then last)."""
    def side(name, order):
        top = freq.orderBy(*order).limit(k)
        return top.select(F.lit(name).alias("side"), F.row_number().over(Window.orderBy(*order)).alias("rank"),   # k rows
                          F.col(col).alias("value"), F.col(n_col).alias("n"))
    return side("most", [F.desc(n_col), F.asc(col)]).unionByName(side("least", [F.asc(n_col), F.desc(col)]))


def distinct_sketches(df: DataFrame, col: str, group_cols: Sequence[str] = (), lg_k: int = 14) -> DataFrame:
    """``(*group_cols, sketch)``: HLL sketches of the distinct values, which merge over groups and tables."""
    return df.groupBy(*group_cols).agg(F.hll_sketch_agg(col, lg_k).alias("sketch"))


def merged_estimate(sketches: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """``(*group_cols, estimate)``: distinct values over the union of the sketches."""
    return sketches.groupBy(*group_cols).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def head(df: DataFrame, order: Sequence[Column], n: int = 5) -> DataFrame:
    """The first n rows in ``order`` (n rows per task, then n rows of those)."""
    return df.orderBy(*order).limit(n)

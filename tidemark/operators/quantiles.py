"""Exact percentiles of counted values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_OCTAVE = 16


def exact_percentile(counted: DataFrame, value: str, n: str, q: float, name: str) -> DataFrame:
    """One row: the linearly interpolated q-percentile of values >= 0 given as (value, count).

    Counts are first added up in logarithmic bins (at most about a thousand).  Only the values of
    the bins that hold the two neighbouring ranks are ordered, so no task sees all values.
    """
    binned = counted.withColumn("_bin", F.floor(
        F.log2(F.col(value).cast("double") + 1.0) * BINS_PER_OCTAVE))
    bins = binned.groupBy("_bin").agg(F.sum(n).alias("_n"))
    running = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = bins.withColumns({
        "_upto": F.sum("_n").over(running),
        "_total": F.sum("_n").over(Window.partitionBy(F.lit(1)))})
    target = (F.col("_total") - 1) * F.lit(q)
    hit = placed.filter(
        (F.col("_upto") > F.floor(target)) & (F.col("_upto") - F.col("_n") <= F.ceil(target)))
    edges = hit.agg(F.struct(
        F.min("_bin").alias("low"), F.max("_bin").alias("high"),
        F.min(F.col("_upto") - F.col("_n")).alias("before"), F.max("_total").alias("total"),
    ).alias("e")).scalar()
    near = binned.filter(F.col("_bin").between(edges["low"], edges["high"])).select(
        F.col(value).alias("_v"), F.col(n).alias("_n"))
    ordered = near.withColumn("_upto", F.sum("_n").over(
        Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + edges["before"])
    at = (edges["total"] - 1) * F.lit(q)
    low = F.min(F.when(F.col("_upto") > F.floor(at), F.col("_v")))
    high = F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_v")))
    return ordered.agg((low + (high - low) * (at - F.floor(at))).alias(name))


def nearest_rank(values: DataFrame, group: list[str], value: str, q: float) -> DataFrame:
    """Per group the smallest value > 0 with at least the share ``q`` of rows at or below it.

    Counts are added up per value and per logarithmic bin; only the values of the bin that holds
    the rank are ordered.
    """
    counted = values.groupBy(*group, value).agg(F.count("*").alias("_n")).withColumn(
        "_bin", F.floor(F.log2(value) * BINS_PER_OCTAVE))
    bins = counted.groupBy(*group, "_bin").agg(F.sum("_n").alias("_n"))
    running = Window.partitionBy(*group).orderBy("_bin").rowsBetween(
        Window.unboundedPreceding, 0)
    hit = bins.withColumns({
        "_upto": F.sum("_n").over(running),
        "_rank": F.ceil(F.sum("_n").over(Window.partitionBy(*group)) * F.lit(q)),
    }).filter("_upto >= _rank and _upto - _n < _rank").select(
        *group, "_bin", "_rank", (F.col("_upto") - F.col("_n")).alias("_before"))
    # one bin per group, and the groups are a fixed list of names
    near = counted.join(F.broadcast(hit), [*group, "_bin"]).withColumn(
        "_upto", F.col("_before") + F.sum("_n").over(
            Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    return near.filter("_upto >= _rank").groupBy(*group).agg(F.min(value).alias(value))

"""Numbering, seeded sampling and top-n without a single-task sort of the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import shared_dir

_POSITION_MASK = (1 << 33) - 1


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1, 2, 3, ... over the whole frame in a total order.

    The frame is range-sorted and checkpointed, which fixes its partitions; each
    partition then only needs the row count of the partitions before it.
    """
    shared_dir(df.sparkSession)
    done = df.orderBy(*order).checkpoint()
    row = F.monotonically_increasing_id()
    placed = done.withColumn("_part", F.shiftright(row, 33).cast("int")).withColumn(
        "_pos", row.bitwiseAND(F.lit(_POSITION_MASK)))
    # one row per partition of the sorted frame
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_before") + F.col("_pos") + F.lit(1)).drop("_part", "_pos", "_before")


def number_within(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                  name: str = "rank") -> DataFrame:
    """1, 2, 3, ... inside each group; a hot group is still sorted by many tasks.

    The first position of each group is joined back; for a short list of groups (labels,
    splits) Spark turns that into a broadcast.
    """
    ranked = number_rows(df, [*[F.col(g) for g in group], *order], "_global")
    starts = ranked.groupBy(*group).agg(F.min("_global").alias("_start"))
    keys = [F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]
    joined = ranked.alias("r").join(starts.alias("s"), keys)
    kept = [F.col(f"r.{c}") for c in df.columns]
    return joined.select(*kept, (F.col("_global") - F.col("_start") + 1).alias(name))


def seeded_key(seed: int | str, key: Column) -> Column:
    """Reproducible random order of a row: md5 of 'seed|key'."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def prune_to_top(df: DataFrame, group: Sequence[str], lead: Column, n: int) -> DataFrame:
    """Drop rows that cannot be among the first n of their group, without ranking them.

    ``lead`` is a coarse, ascending form of the leading sort key with few distinct values.  Rows
    are counted per value; only the values needed to reach n rows are kept (whole values, so no
    candidate is lost).  Null groups are groups.
    """
    marked = df.withColumn("_lead", lead)
    counts = marked.groupBy(*group, "_lead").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group or [F.lit(1)]).orderBy("_lead").rowsBetween(
        Window.unboundedPreceding, -1)
    needed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).filter(
        F.col("_before") < n).select(*[F.col(c).alias(f"_need_{c}") for c in (*group, "_lead")])
    same = [F.col(c).eqNullSafe(F.col(f"_need_{c}")) for c in (*group, "_lead")]
    return marked.join(needed, same, "left_semi").select(*df.columns)


def _seed_lead(seed: int | str, key: str) -> Column:
    """First four hex digits of the seeded key: 65536 evenly filled values."""
    return F.substring(seeded_key(seed, F.col(key)), 1, 4)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows in a seeded random order."""
    df = prune_to_top(df, [], _seed_lead(seed, key), n)
    return df.orderBy(seeded_key(seed, F.col(key)), F.col(key)).limit(n)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int,
                  name: str = "group_rank", lead: Column | None = None) -> DataFrame:
    """The first n rows of each group.

    With a coarse ``lead`` key rows are pruned first, so that a group that holds most rows does not
    reach one task, whatever n is.
    """
    if lead is not None:
        df = prune_to_top(df, group, lead, n)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, rank).filter(F.col(name) <= n)


def sample_per_group(df: DataFrame, group: Sequence[str], n: int, key: str, seed: int = 42,
                     name: str = "group_rank") -> DataFrame:
    return top_per_group(df, group, [seeded_key(seed, F.col(key)), F.col(key)], n, name,
                         _seed_lead(seed, key))


def number_limited(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1, 2, 3, ... over a frame that a limit already bounds (reports, quotas)."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))

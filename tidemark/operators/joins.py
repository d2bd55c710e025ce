"""Joins from many rows to one row per key that stay even when keys are hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more than 1 / SHARES of the rows is hot; there are fewer than SHARES such keys.
SHARES = 256
TRACKED = 10000


def hot_keys(df: DataFrame, key: str, shares: int = SHARES) -> DataFrame:
    """(key, salts): the keys with more than 1 / ``shares`` of the rows, from one pass.

    ``salts`` is the number of shares that a key fills.  Counts are sketched, which is enough:
    the result only routes rows.
    """
    sketch = df.agg(F.expr(f"approx_top_k({key}, {int(shares)}, {TRACKED})").alias("k"),
                    F.count(F.lit(1)).alias("n"))
    found = sketch.select("n", F.explode("k").alias("k")).filter(
        F.col("k.item").isNotNull() & (F.col("k.count") * F.lit(shares) > F.col("n")))
    return found.select(F.col("k.item").alias(key), F.ceil(
        F.col("k.count") * F.lit(shares) / F.col("n")).cast("int").alias("salts"))


def salted(df: DataFrame, hot: DataFrame, key: str, spread: Column | str, salt: str = "_salt"
           ) -> DataFrame:
    """Rows with a salt: 0, and for a hot key the share that the hash of ``spread`` falls into."""
    share = F.coalesce(F.pmod(F.xxhash64(spread), F.col("salts")), F.lit(0))
    return df.join(F.broadcast(hot), key, "left").withColumn(salt, share.cast("int")).drop("salts")


def repeated(unique: DataFrame, hot: DataFrame, key: str, salt: str = "_salt") -> DataFrame:
    """The rows of hot keys once per salt."""
    copies = F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)
    return unique.join(F.broadcast(hot), key, "left").withColumn(salt, F.explode(copies)).drop("salts")


def join_unique(many: DataFrame, unique: DataFrame, key: str, spread: str, how: str = "left",
                hot_from: DataFrame | None = None) -> DataFrame:
    """Join to a frame that holds each key once, spreading the rows of hot keys.

    Rows of a hot key get a salt from the hash of their own ``spread`` column (the same on
    every retry) and the single matching row is repeated once per salt; the salts of a key follow
    its share of the rows.  Other keys keep salt 0, so nothing is repeated for them.  The broadcast
    side has fewer than SHARES rows.  ``hot_from`` is a cheaper frame with the same key, such as
    the stored table behind a long plan, to look for hot keys in.
    """
    source = many if hot_from is None else hot_from
    hot = F.broadcast(hot_keys(source, key).withColumnRenamed("salts", "_salts"))
    salt = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")), F.lit(0))
    left = many.join(hot, key, "left").withColumn("_salt", salt.cast("int")).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    right = unique.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")

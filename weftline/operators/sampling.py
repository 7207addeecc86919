"""Samples and splits that are the same in every run and on every cluster.

Order is by the md5 of seed and key, so no random state is involved. Ranks
within a group are counted in the ranges of the hash and shifted by the sizes
of the ranges before, so a group that holds a third of all rows is ranked in
thousands of pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(key: Column | str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def ranked(df: DataFrame, group: str, key: str, seed: int = 42, name: str = "_rank", digits: int = 3) -> DataFrame:
    """``name``: 1, 2, ... in hash order within ``group``; a null group is a group of its own."""
    df = df.withColumn("_o", order_key(key, seed)).withColumn("_range", F.substring("_o", 1, digits))
    sizes = df.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_g", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(group, "_range").orderBy("_o", key)
    both = df.withColumn(name, F.row_number().over(inside)).join(shifts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return both.withColumn(name, F.col(name) + F.col("_shift")).drop("_o", "_range", "_g", "_r", "_shift")


def per_group(df: DataFrame, group: str, key: str, n: int | Column, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows of each group without replacement."""
    return ranked(df, group, key, seed).where(F.col("_rank") <= n).drop("_rank")


def by_quota(df: DataFrame, quota: DataFrame, group: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of each group as ``quota`` (group, n) allows; groups without a quota are dropped."""
    limited = df.join(F.broadcast(quota), group)  # one row per language of a configuration
    return per_group(limited, group, key, F.col("n"), seed).drop("n")


def test_first(df: DataFrame, quota: DataFrame, group: str, key: str, seed: int = 42) -> DataFrame:
    """``split``: the first ``test`` rows of each group in hash order are test, all others train.

    The train figure of the quota is not a limit.
    """
    wanted = df.join(F.broadcast(quota.select(group, "test")), group)
    return ranked(wanted, group, key, seed).withColumn("split", F.when(F.col("_rank") <= F.col("test"), "test").otherwise("train")).drop("test", "_rank")


def share_per_group(df: DataFrame, group: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """The given share of each group, rounded up."""
    sizes = df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) * share).alias("_want"))
    return ranked(df, group, key, seed).join(sizes, group).where(F.col("_rank") <= F.col("_want")).drop("_rank", "_want")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in hash order."""
    return df.orderBy(order_key(key, seed), key)

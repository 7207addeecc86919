"""Joins that no hot or null key can gather in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT = 1000  # a key is hot above this part of all rows, so there are at most HOT hot keys
_PARTS = 1023


def hot_keys(rows: DataFrame, key: str, count: int | None = None) -> DataFrame:
    """``key``: the at most ``HOT`` values that more than a ``HOT``-th of the rows have (and more than ``HOT`` rows)."""
    n = rows.count() if count is None else count
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where((F.col("_rows") > max(HOT, n / HOT)) & F.col(key).isNotNull()).select(key)


def look_up(rows: DataFrame, found: DataFrame, key: str, by: Column, hot: DataFrame | None = None) -> DataFrame:
    """``rows`` with the columns of ``found``, which has one row a key; null where there is none.

    The keys ``hot`` (default: :func:`hot_keys`) are joined by a broadcast of at
    most ``HOT`` rows. Their rows, and those without a key, are then spread by
    ``by`` through the other join, in which they match nothing.
    """
    values = [c for c in found.columns if c != key]
    hot = hot_keys(rows, key) if hot is None else hot
    few = hot.select(key).distinct().join(found, key, "left").select(key, *[F.col(c).alias(f"_hot_{c}") for c in values], F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot") | F.col(key).isNull(), F.pmod(F.xxhash64(by), F.lit(_PARTS)) + 1).otherwise(F.lit(0).cast("long"))
    out = rows.join(F.broadcast(few), key, "left").withColumn("_salt", salt).join(found.withColumn("_salt", F.lit(0).cast("long")), [key, "_salt"], "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"_hot_{c}"), F.col(c)).alias(c) for c in values])

"""Numbering the rows of each key without gathering a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


PART = 100_000  # rows of a key that are sorted in one task


def number_within(df: DataFrame, key: str, order: list[str], part: int = PART, name: str = "nth") -> DataFrame:
    """``name``: 0, 1, ... within ``key``, the same in every run.

    The rows of each key are spread over as many parts of about ``part`` rows as
    its count asks for, by a hash of ``order``; parts are numbered by themselves and
    shifted by the sizes of the parts before. ``order`` must tell rows apart;
    repeated rows get any of their common numbers. ``df`` is read twice, so it
    should be stored.
    """
    fine = F.pmod(F.xxhash64(*order), F.lit(_FINE)).cast("int")
    per = df.groupBy(key, fine.alias("_fine")).agg(F.count(F.lit(1)).alias("_n"))  # at most _FINE rows a key
    whole = Window.partitionBy(key)
    before = whole.orderBy("_fine").rowsBetween(Window.unboundedPreceding, -1)
    parts = F.ceil(F.sum("_n").over(whole) / part)
    # neighbouring hash ranges form a part
    ranges = per.select(key, "_fine", "_n", F.floor(F.col("_fine") * parts / _FINE).alias("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    shifts = ranges.withColumn("_shift", F.min("_before").over(Window.partitionBy(key, "_part"))).select(key, "_fine", "_part", "_shift")
    inside = Window.partitionBy(key, "_part").orderBy("_fine", *order)
    return (
        df.withColumn("_fine", fine)
        .join(shifts, [key, "_fine"])
        .withColumn(name, (F.row_number().over(inside) - 1 + F.col("_shift")).cast("long"))
        .drop("_fine", "_part", "_shift")
    )


_FINE = 4096


def running_total(df: DataFrame, weight: str, order: Column, name: str = "total", bits: int = 12) -> DataFrame:
    """``name``: the sum of ``weight`` over all rows up to this one in ``order``.

    ``order`` is a hash (long); rows are cut into 2^bits ranges of it, whose sums
    are added up first, so that no task sees more than one range of the rows.
    """
    df = df.withColumn("_o", order).withColumn("_range", F.shiftrightunsigned(F.col("_o").bitwiseXOR(F.lit(-(2**63))), 64 - bits))
    sums = df.groupBy("_range").agg(F.sum(weight).alias("_w"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("_range", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_range").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.join(F.broadcast(shifts), "_range")  # at most 2^bits rows
        .withColumn(name, F.sum(weight).over(inside) + F.col("_shift"))
        .drop("_o", "_range", "_shift")
    )

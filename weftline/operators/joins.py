"""Joins by id, merges and what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with the same key the last in ``order`` wins; partial aggregation keeps one row a task and key."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def complete(left: DataFrame, *others: DataFrame, on: str | list[str] = "custom_id", needed: list[str] = ()) -> DataFrame:
    """Inner joins by id; rows whose needed columns are null, empty or ``ERROR`` are dropped."""
    out = left
    for other in others:
        out = out.join(other, on)
    for c in needed:
        out = out.where(F.col(c).isNotNull() & (F.col(c) != "") & (F.col(c) != "ERROR"))
    return out


def upsert(old: DataFrame, new: DataFrame, on: str) -> DataFrame:
    """Fields of ``new`` replace those of ``old``; keys of either side stay."""
    a, b = old.alias("a"), new.alias("b")
    fields = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != on]
    pick = [
        F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in old.columns and c in new.columns else F.col(f"b.{c}" if c in new.columns else f"a.{c}") for c in fields
    ]
    return a.join(b, F.col(f"a.{on}") == F.col(f"b.{on}"), "full").select(F.coalesce(f"a.{on}", f"b.{on}").alias(on), *pick)


def pending(all_ids: DataFrame, done: DataFrame, on: str, output: str) -> DataFrame:
    """Ids without a non-blank output; repeated and failed attempts don't matter."""
    good = done.where(F.trim(F.coalesce(output, F.lit(""))) != "").select(on).distinct()
    return all_ids.join(good, on, "left_anti")


def filled_in(base: DataFrame, retry: DataFrame, on: str, column: str) -> DataFrame:
    """Nulls of ``column`` replaced by the retry's value."""
    again = retry.where(F.col(column).isNotNull()).groupBy(on).agg(F.first(column).alias("_again"))
    return base.join(again, on, "left").withColumn(column, F.coalesce(column, "_again")).drop("_again")


def without(df: DataFrame, bad: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not listed."""
    return df.join(bad.select(*on).distinct(), on, "left_anti")

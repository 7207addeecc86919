"""Filters around model calls and the batch form of scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within_budget(df: DataFrame, tokens: Column, most: int = 32_768) -> DataFrame:
    """Rows whose prompt is not longer than the trainer takes."""
    return df.where(tokens <= most)


def undecided_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """Groups of answers that are neither all right nor all wrong, with their mean."""
    out = df.groupBy(group).agg(F.min(value).alias("_min"), F.max(value).alias("_max"), F.round(F.avg(value), 6).alias("mean"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("_min") < F.col("_max")).drop("_min", "_max")


def pending_files(inputs: DataFrame, outputs: DataFrame, name: str = "file") -> DataFrame:
    """Input files without an output of the same name behind ``output_``."""
    done = outputs.select(F.regexp_replace(name, "^output_", "").alias(name)).distinct()
    return inputs.join(done, name, "left_anti")


def has_output(c: Column) -> Column:
    """a prediction that is there and not blank."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"\s", " ")) != "", F.lit(False))

"""Writing records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl_batches(df: DataFrame, path: str, by: tuple[str, ...] = ("language", "batch")) -> None:
    """K1: JSON lines in one folder per language and batch; other characters than ASCII stay as they are."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).json(path)


def by_language(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """K2, K3: one Parquet table in partitions of languages, which also is the merged table."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("language").parquet(path)


def stats(df: DataFrame, path: str) -> None:
    """K5: figures as JSON, one small file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def once(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """K6: existing results are only replaced if asked to."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def ordered(df: DataFrame, path: str, key: str = "index") -> None:
    """Rows in the order of ``key`` across the files; Spark's commit makes the replacement atomic.

    Failed rows are rows too: nothing waits for a missing index, so none is lost.
    """
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").json(path)

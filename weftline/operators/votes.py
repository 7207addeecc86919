"""Samples that most models fail, and where to draw the line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(results: DataFrame) -> DataFrame:
    """A4: ``language``, ``index``, ``votes``: how many models failed a sample; ``results`` has score 0 or 1 per model."""
    return results.where(F.col("score") == 0).groupBy("language", "index").agg(F.count(F.lit(1)).alias("votes"))


def histogram(votes: DataFrame) -> DataFrame:
    """A5: ``language``, ``votes``, ``samples``."""
    return votes.groupBy("language", "votes").agg(F.count(F.lit(1)).alias("samples"))


def thresholds(hist: DataFrame, models: DataFrame, least: int = 5) -> DataFrame:
    """``language``, ``threshold``: from ``least - 1`` up while a bucket is larger than the next, at most the number of models.

    The loop is a closed form over the histogram, which has as many rows as there
    are models: the smallest count from the start whose bucket is not larger than
    the next one, or the largest count.
    """
    top = hist.groupBy("language").agg(F.max("votes").alias("top"), F.map_from_entries(F.collect_list(F.struct("votes", "samples"))).alias("h"))
    size = lambda t: F.coalesce(F.try_element_at(F.col("h"), t), F.lit(0))
    start = F.greatest(F.lit(1), F.least(F.lit(least - 1), F.col("top")))
    steps = F.filter(F.sequence(start.cast("long"), F.col("top")), lambda t: (size(t) <= size(t + 1)) | (t == F.col("top")))
    out = models.join(top, "language", "left")
    chosen = F.least(F.array_min(steps), F.col("models"))
    return out.select("language", F.when(F.col("top").isNull() | (F.col("models") <= 0), F.lit(least)).otherwise(chosen).cast("long").alias("threshold"))


def rejected(votes: DataFrame, limits: DataFrame) -> DataFrame:
    """Samples with at least as many votes as their language's threshold."""
    return votes.join(limits, "language").where(F.col("votes") >= F.col("threshold")).select("language", "index", "votes")


def by_votes(votes: DataFrame, models: int, shown: int = 50, least: int = 4) -> DataFrame:
    """``language``, ``votes``, ``share`` of the models in percent, ``samples`` and ``shown``: their first ids, for counts of at least ``least``.

    Ids are ranked before they are gathered, so a group sends no more than ``shown``; 0 shows all.
    """
    groups = votes.groupBy("language", "votes").agg(F.count(F.lit(1)).alias("samples"))
    listed = votes.where(F.col("votes") >= least)
    if shown:
        listed = listed.withColumn("nth", F.row_number().over(Window.partitionBy("language", "votes").orderBy("index"))).where(F.col("nth") <= shown)
    ids = listed.groupBy("language", "votes").agg(F.sort_array(F.collect_list("index")).alias("shown"))
    share = F.round(F.col("votes") * 100.0 / models, 1) if models > 0 else F.lit(0.0)
    return groups.join(ids, ["language", "votes"], "left").select("language", "votes", share.alias("share"), "samples", "shown")

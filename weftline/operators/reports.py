"""Figures per language, model and kind of error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def total(df: DataFrame, column: str) -> int:
    """The sum of a column: one number on the driver."""
    return df.agg(F.sum(column)).first()[0] or 0


def accuracy(scored: DataFrame, language: Column, overall: bool = False) -> DataFrame:
    """A1: ``language``, ``samples``, ``accuracy``; with ``overall`` also a row for all (language ``ALL``)."""
    df = scored.withColumn("language", language)
    figures = [F.count(F.lit(1)).alias("samples"), F.round(F.avg("score"), 6).alias("accuracy")]
    if not overall:
        return df.groupBy("language").agg(*figures)
    out = df.rollup("language").agg(*figures, F.grouping("language").alias("_all"))
    return out.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("language")).alias("language"), "samples", "accuracy")


def pivot(scored: DataFrame, models: list[str]) -> DataFrame:
    """A row per language and one for all, a column of accuracies per model; models without rows stay null."""
    cells = [F.round(F.avg(F.when(F.col("model") == m, F.col("score"))), 6).alias(m) for m in models]
    out = scored.rollup("language").agg(*cells, F.grouping("language").alias("_all"))
    return out.select(F.when(F.col("_all") == 1, "Average").otherwise(F.col("language")).alias("language"), *models)


def language_cells(counts: DataFrame, order: list[str]) -> DataFrame:
    """``language`` and ``cell``: with the number of samples, if all labels agree on it, else that of each label in ``order``.

    ``counts`` has language, label and n, a row per pair; labels without samples don't count.
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col("label"))
    rows = counts.where((place > 0) & (F.col("n") > 0)).groupBy("language").agg(F.sort_array(F.collect_list(F.struct(place.alias("at"), "label", "n"))).alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    each = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["label"], x["n"].cast("string"))), ", ")
    cell = F.concat(F.col("language"), F.lit(" ("), F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(each), F.lit(")"))
    return counts.select("language").distinct().join(rows.select("language", cell.alias("cell")), "language", "left").select("language", F.coalesce("cell", "language").alias("cell"))


def run_summary(predictions: DataFrame, answer: Column, elapsed: Column) -> DataFrame:
    """One row: ``n``, ``success`` (a prediction that isn't empty), ``failed``, total and mean seconds (0 without rows)."""
    ok = F.coalesce(answer != "", F.lit(False)).cast("long")
    out = predictions.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(ok), F.lit(0)).alias("success"), F.coalesce(F.sum(elapsed), F.lit(0.0)).alias("total_s"))
    return out.select("n", "success", (F.col("n") - F.col("success")).alias("failed"), F.round("total_s", 6).alias("total_s"), F.round(F.when(F.col("n") > 0, F.col("total_s") / F.col("n")).otherwise(0.0), 6).alias("mean_s"))


def markdown(table: DataFrame, first: str, columns: list[str], last: str = "Average") -> DataFrame:
    """K9: the lines of a Markdown table as (``part``, ``name``, ``line``): header, rule, rows by name, the average last; halves are rounded to even."""
    cell = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.2f%%", F.bround(F.col(c) * 100, 2))).otherwise("")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.col(first), *map(cell, columns)), F.lit(" |"))
    spark = table.sparkSession
    head = [(0, "", "| " + " | ".join([first, *columns]) + " |"), (1, "", "|" + "---|" * (len(columns) + 1))]
    body = table.select(F.when(F.col(first) == last, 3).otherwise(2).alias("part"), F.col(first).alias("name"), row.alias("line"))
    return spark.createDataFrame(head, "part int, name string, line string").union(body)


def error_ratios(classified: DataFrame, types: DataFrame) -> DataFrame:
    """``error_type``, ``n``, ``ratio``: all classes, also those that don't occur, and any other name."""
    return error_ratios_by(classified.withColumn("source", F.lit("final")), types, ["final"]).drop("source")


def error_ratios_by(classified: DataFrame, types: DataFrame, sources: list[str]) -> DataFrame:
    """``source`` (final, rule, llm), ``error_type``, ``n``, ``ratio`` within the source; a null type counts nowhere."""
    counts = classified.where(F.col("error_type").isNotNull()).groupBy("source", "error_type").agg(F.count(F.lit(1)).alias("n"))
    every = types.select("error_type").withColumn("source", F.explode(F.array(*map(F.lit, sources))))
    out = every.join(counts, ["source", "error_type"], "full").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = F.sum("n").over(Window.partitionBy("source"))  # a row per source and type
    return out.select("source", "error_type", "n", F.round(F.when(whole > 0, F.col("n") / whole).otherwise(0.0), 6).alias("ratio"))


def pass_rates(judged: DataFrame, passed: Column) -> DataFrame:
    """Total, passed, failed and rate per language and for all (``ALL``)."""
    out = judged.withColumn("_p", passed.cast("int")).rollup("language").agg(F.count(F.lit(1)).alias("total"), F.sum("_p").alias("passed"), F.grouping("language").alias("_all"))
    return out.select(
        F.when(F.col("_all") == 1, "ALL").otherwise(F.coalesce("language", F.lit("unknown"))).alias("language"), "total", "passed", (F.col("total") - F.col("passed")).alias("failed"),
        T.percent(F.col("passed"), F.col("total")).alias("pass_rate"),
    )


def latency(df: DataFrame, group: str, seconds: str, tokens: str) -> DataFrame:
    """Mean, 95th percentile (interpolated) and throughput per group."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(seconds), 6).alias("mean_s"), F.round(F.percentile(seconds, 0.95), 6).alias("p95_s"),
        F.round(F.sum(tokens) / F.sum(seconds), 6).alias("tokens_per_s"),
    )


def terciles(df: DataFrame, value: str, name: str = "bucket") -> DataFrame:
    """``low``, ``mid`` or ``high`` by the interpolated thirds of ``value``."""
    # equal values are counted first, so the percentile sees each value once
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    cuts = counts.agg(F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3)), F.col("_n"))).first()[0] or [0.0, 0.0]
    bucket = F.when(F.col(value) <= cuts[0], "low").when(F.col(value) <= cuts[1], "mid").otherwise("high")
    return df.withColumn(name, bucket)


def cost(tokens_in: Column, tokens_out: Column, per_in: float = 1.25, per_out: float = 5.0) -> Column:
    """The price of requests, per million tokens."""
    return F.round(tokens_in / 1e6 * per_in + tokens_out / 1e6 * per_out, 6)


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` most frequent values with their share in percent; ties by value."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    shares = counts.select(key, "n", T.percent(F.col("n"), F.lit(total(counts, "n"))).alias("percent"))
    return shares.orderBy(F.desc("n"), key).limit(k)


def in_order(df: DataFrame, key: str, first: list[str]) -> DataFrame:
    """``position``: values in the given order, then all others by name."""
    known = reduce(lambda c, i: c.when(F.col(key) == first[i], i), range(len(first)), F.when(F.lit(False), 0))
    return df.orderBy(F.coalesce(known, F.lit(len(first))), key)

"""Token batches, merged intervals and token budgets."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, stored

LIMIT, ROWS = 90_000, 1_000_000


def token_count(c: Column) -> Column:
    """The default counter: words and single marks, counted in the JVM; any other column can replace it."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]")).cast("long")


def budgets(user_tokens: Column) -> Column:
    """Struct of the output budgets of the pipeline's steps."""
    return F.struct(F.lit(8192).alias("describe"), F.floor(user_tokens * 10).cast("long").alias("code"), F.floor(user_tokens * 1.8).cast("long").alias("verify"), F.least(F.floor(user_tokens * 10).cast("long"), F.lit(64000)).alias("streamed"))


def token_batches(df: DataFrame, group: str, order: str, tokens: str, limit: int = LIMIT, rows: int = ROWS) -> DataFrame:
    """``batch``, from 1: rows in order share a batch until the next one would pass ``limit``.

    A row above the limit has a batch of its own. Packing depends on all rows
    before, so rows are folded in order, on ids and counts only. Tables above
    ``rows`` rows are cut into ranges of about that many rows in order of group and
    id, so no task gets more. Each range first tells its outcome for any fill of
    the batch that is open at its start (:func:`outcome`), the ranges of a group
    are chained, and then each is folded from its true start: batches are the
    same at every size and wherever the ranges begin. Null counts weigh nothing.
    """
    slim = df.select(group, order, F.col(tokens).alias("tokens"))
    kind = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    ranges = max(1, -(-slim.count() // rows))
    if ranges == 1:
        slim = slim.withColumn("stretch", F.lit(0)).withColumn("_fill", F.lit(0).cast("long")).withColumn("_open", F.lit(1).cast("long"))
    else:
        slim = cut(slim.repartitionByRange(ranges, group, order).withColumn("stretch", F.spark_partition_id()))

        def tell(part: pd.DataFrame) -> pd.DataFrame:
            told = outcome(part.sort_values(order, kind="stable").tokens.fillna(0).to_numpy(np.int64), limit)
            return part[[group, "stretch"]].head(1).assign(**{k: [v] for k, v in told.items()})

        def chain(told: pd.DataFrame) -> pd.DataFrame:
            told = told.sort_values("stretch")
            fill, opened, out = 0, 1, []
            for r in told.itertuples(index=False):
                out.append((fill, opened))
                at = bisect.bisect_right(r.ends, limit - fill)
                if fill == 0:
                    fill, opened = r.fresh_fill, opened + r.fresh
                elif at == len(r.ends):
                    fill += r.total
                else:
                    fill, opened = r.fills[at], opened + r.batches[at]
            return told[[group, "stretch"]].assign(_fill=[f for f, _ in out], _open=[n for _, n in out])

        told = slim.groupBy(group, "stretch").applyInPandas(tell, f"{group} {kind[group]}, stretch int, ends array<long>, batches array<long>, fills array<long>, total long, fresh long, fresh_fill long")
        starts = told.groupBy(group).applyInPandas(chain, f"{group} {kind[group]}, stretch int, _fill long, _open long").withColumnRenamed(group, "_group").withColumnRenamed("stretch", "_stretch")
        slim = slim.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("stretch") == F.col("_stretch"))).drop("_group", "_stretch")

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        batch, used, out = int(part._open.iloc[0]), int(part._fill.iloc[0]), []
        for n in part.tokens.fillna(0):
            if used and used + n > limit:
                batch, used = batch + 1, 0
            used += n
            out.append(batch)
        return part.assign(batch=out)[[group, order, "tokens", "batch"]]

    return slim.groupBy(group, "stretch").applyInPandas(fold, f"{group} {kind[group]}, {order} {kind[order]}, tokens {kind['tokens']}, batch long")


def outcome(tokens: np.ndarray, limit: int) -> dict:
    """What a range of rows does to the batch that is open before it.

    The first row that doesn't fit opens a batch, and all behind it follows from
    that row alone. Row k of ``ends`` (sums up to a row that can be the first) is
    taken if its sum is the first above ``limit`` less the fill; ``batches`` are
    then opened and the last is left with ``fills``. Without such a row ``total`` is
    added. ``fresh`` and ``fresh_fill`` hold for an open batch of no tokens.
    """
    n, sums = len(tokens), np.concatenate([[0], np.cumsum(tokens)])
    # the next batch opens where the sum passes the limit, but never before this one has a token
    after = np.minimum(n, np.maximum(np.searchsorted(sums, sums[:-1] + limit, "right") - 1, np.searchsorted(sums, sums[:-1], "right"))).tolist()
    batches, fills, total = [0] * (n + 1), [0] * (n + 1), int(sums[-1])
    for p in range(n - 1, -1, -1):
        q = after[p]
        batches[p], fills[p] = batches[q] + 1, total - int(sums[p]) if q == n else fills[q]
    last = min(n - 1, int(np.searchsorted(sums[1:], limit - 1, "right")))
    firsts = [p for p in range(last + 1) if p == 0 or tokens[p] > 0]
    return {"ends": [int(sums[p + 1]) for p in firsts], "batches": [batches[p] for p in firsts], "fills": [fills[p] for p in firsts], "total": total, "fresh": batches[0] - 1, "fresh_fill": fills[0]}


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Intervals that overlap or touch become one, per key (gaps and islands).

    Rows are cut into stretches in order of key and start. A stretch learns how far
    the ones before it in its key reach, and how many islands they open, so windows
    never hold more than a stretch of a key.
    """
    slim = stored(df.select(key, start, end).distinct().repartitionByRange(key, start, end).withColumn("_at", F.spark_partition_id()), "intervals")
    # one row for each key in a stretch
    before = Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    same = lambda a, b: a[key].eqNullSafe(b[f"_{key}"]) & (a["_at"] == b["_there"])
    known = lambda per, name: per.select(F.col(key).alias(f"_{key}"), F.col("_at").alias("_there"), name)
    reach = known(slim.groupBy(key, "_at").agg(F.max(end).alias("_most")).withColumn("_reach", F.max("_most").over(before)), "_reach")
    inside = Window.partitionBy(key, "_at").orderBy(start, end)
    so_far = F.greatest("_reach", F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    opened = slim.join(reach, same(slim, reach)).drop(f"_{key}", "_there").withColumn("_new", F.when(F.col(start) <= so_far, 0).otherwise(1))
    opened = stored(opened.select(key, start, end, "_at", "_new"), "opened")
    first = known(opened.groupBy(key, "_at").agg(F.sum("_new").alias("_here")).withColumn("_first", F.coalesce(F.sum("_here").over(before), F.lit(0))), "_first")
    number = F.col("_first") + F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    island = opened.join(first, same(opened, first)).drop(f"_{key}", "_there").withColumn("_island", number)
    return island.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")

"""Problem 9: filling containers of fixed capacity with whole texts.

All planning happens on the global histogram of lengths, which has at most
``capacity`` entries however large the corpus is. Dynamic programming chooses
the bounds of length buckets with the least padding, and batches under a budget
of tokens form inside each bucket, the longest first: a container takes texts of
its bucket as long as they fit. What then is left of it (almost half, where texts
are just above half the capacity) is topped up from shorter buckets: by one or
two lengths that fill it to the last token, else by the longest that fits. A
filling is repeated as often as the histogram allows. ``bucket_batches`` is the
method without topping up, with padded batches, for comparison.

Defined results: a null text and a text without tokens have no piece; a text
longer than the capacity is cut into full containers and a rest, which is
packed like a text; ties and repeated rows are told apart by their key and
order of hash; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, stored, table
from .p8_encoding import count_tokens
from .ranking import number_within

CAPACITY, BUCKETS = 2048, 16


def length_buckets(hist: dict[int, int], k: int) -> list[int]:
    """Upper bounds of at most ``k`` buckets that minimise the padding to the bound."""
    lengths = sorted(n for n in hist if hist[n] > 0)
    if not lengths:
        return []
    size = np.array([0, *np.cumsum([hist[n] for n in lengths])], dtype=np.int64)
    mass = np.array([0, *np.cumsum([hist[n] * n for n in lengths])], dtype=np.int64)
    m, k = len(lengths), min(k, len(lengths))
    best = np.full(m + 1, np.iinfo(np.int64).max // 4)
    best[0], back = 0, []
    for _ in range(k):
        new, arg = best.copy(), np.full(m + 1, -1)
        for j in range(1, m + 1):
            cost = best[:j] + (size[j] - size[:j]) * lengths[j - 1] - (mass[j] - mass[:j])
            i = int(cost.argmin())
            if cost[i] < new[j]:
                new[j], arg[j] = cost[i], i
        best = new
        back.append(arg)
    bounds, j = [], m
    for arg in reversed(back):
        if arg[j] >= 0:
            bounds.append(lengths[j - 1])
            j = int(arg[j])
        if not j:
            break
    return bounds[::-1]


def plan(hist: dict[int, int], capacity: int = CAPACITY, buckets: int = BUCKETS) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fillings as (how often, [(length, how many), ...]); they use up ``hist``."""
    left, least = np.zeros(capacity + 1, dtype=np.int64), np.zeros(capacity + 1, dtype=np.int64)
    for n, c in hist.items():
        left[n] = c
    above = 0
    for bound in length_buckets(hist, buckets):
        least[above + 1 : bound + 1] = above + 1
        above = bound
    out = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return out
        used: dict[int, int] = {}
        room = capacity

        def take(n: int, used: dict[int, int] = used) -> None:
            nonlocal room
            used[n] = used.get(n, 0) + 1
            left[n] -= 1
            room -= n

        longest = int(there[-1])
        low = int(least[longest])
        take(longest)
        while room >= low and len(own := np.flatnonzero(left[low : min(room, longest) + 1])):
            take(low + int(own[-1]))  # the batch inside the bucket
        while room:
            if left[room]:
                take(room)
                break
            small = np.flatnonzero(left[: room + 1])
            if not len(small):
                break
            other = room - small
            pair = small[(left[other] > 0) & ((other != small) | (left[small] > 1))]
            if len(pair):
                a = int(pair[-1])
                b = room - a
                take(a)
                take(b)
                break
            take(int(small[-1]))
        times = 1 + min(int(left[n]) // c for n, c in used.items())
        for n, c in used.items():
            left[n] -= c * (times - 1)
        out.append((times, sorted(used.items(), reverse=True)))


def _segments(fillings: list, first: int) -> dict[int, tuple[list, list]]:
    """For each length: from which number on, (container of it, how many of it in one, slot, place)."""
    seen: dict[int, int] = {}
    out: dict[int, tuple[list, list]] = {}
    for times, used in fillings:
        slot = place = 0
        for n, c in used:
            begins, what = out.setdefault(n, ([], []))
            begins.append(seen.get(n, 0))
            what.append((first, c, slot, place))
            seen[n] = seen.get(n, 0) + c * times
            slot += c
            place += c * n
        first += times
    return out


def pieces(sizes: DataFrame, key: str, capacity: int) -> DataFrame:
    """``key``, ``piece``, ``token_start`` and ``n_tokens`` of each piece of at most ``capacity`` tokens."""
    n = F.col("n_tokens")
    parts = F.ceil(n / capacity).cast("int")
    return (
        sizes.where(n > 0)
        .select(key, n, F.explode(F.sequence(F.lit(0), parts - 1)).alias("piece"))
        .select(key, "piece", (F.col("piece") * capacity).cast("long").alias("token_start"), F.least(F.lit(capacity), n - F.col("piece") * capacity).cast("long").alias("n_tokens"))
    )


def pack(sizes: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``key``, ``piece``, ``token_start``, ``n_tokens``, ``container``, ``slot`` and ``position``.

    ``sizes`` has ``key`` and ``n_tokens``. ``slot`` counts the pieces in the
    container, ``position`` the tokens before this one.
    """
    parts = stored(pieces(sizes, key, capacity), "pieces")
    hist = {r[0]: r[1] for r in parts.groupBy("n_tokens").count().collect()}  # at most `capacity` rows
    segments = parts.sparkSession.sparkContext.broadcast(_segments(plan(hist, capacity), 0))  # bounded like the histogram

    @F.pandas_udf("container long, slot int, position int")
    def place(n: pd.Series, nth: pd.Series) -> pd.DataFrame:
        length, number = n.to_numpy(), nth.to_numpy()
        out = np.zeros((len(n), 3), np.int64)
        for one in np.unique(length):  # `capacity` lengths at most
            begins, what = segments.value[int(one)]
            rows = np.flatnonzero(length == one)
            begins, what = np.array(begins), np.array(what)
            at = np.searchsorted(begins, number[rows], side="right") - 1
            container, c, slot, position = what[at].T
            whole, rest = np.divmod(number[rows] - begins[at], c)
            out[rows] = np.stack([container + whole, slot + rest, position + rest * one], axis=1)
        return pd.DataFrame(out, columns=["container", "slot", "position"])

    numbered = number_within(parts, "n_tokens", [key, "piece"])
    return numbered.withColumn("at", place("n_tokens", "nth")).select(key, "piece", "token_start", "n_tokens", "at.container", "at.slot", "at.position")


def bucket_batches(sizes: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """The method without topping up: ``key``, ``piece``, ``bound``, ``batch``, ``slot``; a batch holds ``capacity // bound`` pieces."""
    parts = stored(pieces(sizes, key, capacity), "pieces")
    hist = {r[0]: r[1] for r in parts.groupBy("n_tokens").count().collect()}  # at most `capacity` rows
    bounds = length_buckets(hist, buckets) or [capacity]
    bound = F.element_at(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b >= F.col("n_tokens")), 1)
    per = F.floor(F.lit(capacity) / F.col("bound"))
    numbered = number_within(parts.withColumn("bound", bound), "bound", [key, "piece"])
    return numbered.select(key, "piece", "n_tokens", "bound", F.floor(F.col("nth") / per).alias("batch"), F.pmod("nth", per).cast("int").alias("slot"))


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(count_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def p9_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per bucket: pieces, batches and the share of room left unused."""
    out = bucket_batches(count_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))
    grouped = out.groupBy("bound").agg(F.count(F.lit(1)).alias("pieces"), F.countDistinct("batch").alias("batches"), F.sum("n_tokens").alias("tokens"))
    return grouped.withColumn("unused", F.round(1 - F.col("tokens") / (F.col("batches") * CAPACITY), 6))


def p9_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens, unused room and the least number of containers possible."""
    out = pack(count_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))
    by = out.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return by.agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens")).withColumn("unused", F.round(1 - F.col("tokens") / (F.col("containers") * CAPACITY), 6)).withColumn("least", F.ceil(F.col("tokens") / CAPACITY))


QUERIES = {"p9_packed": (p9_packed, None), "p9_buckets": (p9_buckets, None), "p9_room": (p9_room, None)}

"""Problem 6: near-duplicate records, by a chosen-path join.

Records become sets of shingles; records with the same set are one class, so
copies cost nothing. In each of ``runs`` independent runs every set starts at
a root and, at each level, walks into the children named by those of its own
tokens whose hash, together with the path so far, falls below
``2^64 / (similarity * size)``. Two sets meet in a child if they share its
token, so a pair at the threshold meets in one child per level on average, and
a dissimilar pair in far less than one. Buckets of at most ``small`` sets are
compared outright; larger ones are split by further levels. Candidates are
then checked exactly. With similarity s of the larger set shared, one run
misses a pair with the probability that a branching process of mean
``s / similarity`` dies out within ``depth`` levels; over ``runs`` runs that is
below 1e-4 at the threshold itself (``missed`` computes it) and falls fast above it.
A pair in a large bucket has to meet on deeper levels, which one run misses more
often: classes that lie in any large bucket get further runs until their pairs are
lost with no more than ``LOST`` less the chance of the first runs, reckoned at the
deepest level that was reached (``runs_for``).

Defined results: a null field counts as an empty text; texts of fewer than
three words match nothing; repeated rows match with similarity 1; an empty
table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, stored, table
from .contraction import components
from .shingles import mix, shingles, signature
from .skew import look_up

SIMILARITY, RUNS, DEPTH, DEEPEST, SMALL, BLOCK = 0.7, 20, 3, 7, 64, 256
LOST = 1e-4  # greatest chance to miss a pair at the threshold, whatever the size of its buckets


def missed(shared: float, similarity: float = SIMILARITY, runs: int = RUNS, depth: int = DEPTH) -> float:
    """The chance that a pair with ``shared`` of the larger set in common never meets."""
    q = 0.0
    for _ in range(depth):
        q = math.exp(-shared / similarity * (1 - q))
    return q**runs


def runs_for(level: int, runs: int = RUNS, depth: int = DEPTH) -> int:
    """The runs that a pair at the threshold needs if it must meet ``level`` levels deep.

    Its chance to be missed in them and the chance never to share a bucket in
    ``runs`` runs of ``depth`` add up to ``LOST``; too few ``runs`` for that may
    at most be doubled in their chance.
    """
    first = missed(1.0, 1.0, runs, depth)
    left = LOST - first if first < LOST else first
    return runs if level <= depth else max(runs, math.ceil(math.log(left) / math.log(missed(1.0, 1.0, 1, level))))


def roots(first: int, last: int) -> np.ndarray:
    """The roots of the runs from ``first`` to before ``last``."""
    return mix(np.arange(first + 1, last + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def walk(nodes: np.ndarray, tokens: np.ndarray, levels: int, similarity: float) -> np.ndarray:
    """The nodes that a set reaches ``levels`` below ``nodes``."""
    bound = np.uint64(min(2**64 - 1, int(2**64 / (similarity * max(1, len(tokens))))))
    wide = tokens.astype(np.uint64)
    for _ in range(levels):
        if not len(nodes):
            break
        below = mix(mix(nodes)[:, None] + wide[None, :] * np.uint64(0xD6E8FEB86659FD93))
        nodes = below[below < bound]
    return nodes


def sketch(tokens: np.ndarray) -> np.ndarray:
    """128 bits, each the parity of a minimal hash: two sets agree in (1 + similarity) / 2 of them."""
    low = (mix(tokens.astype(np.uint64))[None, :] * _SKETCH[:, None]).min(axis=1)
    return np.packbits((mix(low) & np.uint64(1)).astype(np.uint8)).view(np.int64)


_SKETCH = mix(np.arange(1001, 1129, dtype=np.uint64)) | np.uint64(1)


def sets(df: DataFrame, key: str, text: Column, runs: int, depth: int, similarity: float) -> DataFrame:
    """``id``, ``cls`` (identity of the set), ``n``, ``tokens``, ``nodes``, ``s1`` and ``s2``.

    Rows of too few words are left out. A task gives the arrays of a class only
    with the first row that it sees of it, so copies add no more than their ids.
    """
    top = roots(0, runs)
    none32, none64 = np.empty(0, np.int32), np.empty(0, np.int64)

    def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        ends = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts) if parts else [], kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    s = shingles(text)
                    if not len(s):
                        continue
                    cls = signature(s)
                    if cls in seen:
                        rows.append((i, cls, len(s), none32, none64, None, None))
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(cls)
                    rows.append((i, cls, len(s), s.view(np.int32), walk(top, s, depth, similarity).astype(np.int64), *map(int, sketch(s))))
                c = list(zip(*rows)) if rows else [()] * 7
                arrays = [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), lists(c[3], pa.int32()), lists(c[4], pa.int64()), pa.array(c[5], pa.int64()), pa.array(c[6], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "cls", "n", "tokens", "nodes", "s1", "s2"])

    schema = "id long, cls long, n int, tokens array<int>, nodes array<long>, s1 long, s2 long"
    return df.select(F.col(key).cast("long").alias("id"), text.alias("t")).mapInArrow(run, schema)


def deeper(at: DataFrame, tokens: DataFrame, levels: int, similarity: float) -> DataFrame:
    """Split the buckets of ``at`` (node, cls) by further levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, cls, toks = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            ends, flat = toks.offsets.to_numpy(), toks.values.to_numpy().view(np.uint32)
            rows = []
            for i in range(batch.num_rows):
                own = walk(np.array([node[i]], np.int64).view(np.uint64), flat[ends[i] : ends[i + 1]], levels, similarity)
                rows += [(x, cls[i]) for x in own.view(np.int64).tolist()]
            a, b = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["node", "cls"])

    return at.join(tokens, "cls").select("node", "cls", "tokens").mapInArrow(run, "node long, cls long")


def again(tokens: DataFrame, first: int, last: int, depth: int, similarity: float) -> DataFrame:
    """``node`` and ``cls`` of the runs from ``first`` to before ``last`` of the sets ``tokens`` (cls, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = roots(first, last)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cls, toks = part.column(0).to_numpy(), part.column(1)
                ends, flat = toks.offsets.to_numpy(), toks.values.to_numpy().view(np.uint32)
                own = [walk(top, flat[ends[i] : ends[i + 1]], depth, similarity) for i in range(part.num_rows)]
                nodes = np.concatenate(own).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.repeat(cls, [len(x) for x in own]), pa.int64())], ["node", "cls"])

    return spread(tokens.select("cls", "tokens")).mapInArrow(run, "node long, cls long")


def shared_buckets(at: DataFrame) -> DataFrame:
    """``node``, ``cls`` and ``size`` of the buckets with at least two classes; one shuffle."""
    rows = at.repartition("node").distinct()
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    return rows.join(sizes, "node")


def meetings(at: DataFrame, block: int = BLOCK) -> DataFrame:
    """All pairs of classes in the same bucket of ``at`` (node, cls, size).

    A bucket of more than ``block`` classes is compared in blocks: one side is cut into
    parts of about ``block``, which the other side visits one by one, in tasks of their own.
    """
    parts = F.ceil(F.col("size") / block).cast("int")
    a = at.select("node", F.col("cls").alias("a"), F.pmod(F.xxhash64("cls"), parts).cast("int").alias("part"))
    b = at.select("node", F.col("cls").alias("b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return a.join(b, ["node", "part"]).where(F.col("a") < F.col("b")).select("a", "b")


def similar_classes(records: DataFrame, similarity: float = SIMILARITY, depth: int = DEPTH, deepest: int = DEEPEST, small: int = SMALL, runs: int = RUNS) -> DataFrame:
    """``a``, ``b``, ``similarity`` of each pair of different classes of ``records`` (stored :func:`sets` of ``runs`` runs).

    Classes that lie in any bucket of more than ``small`` walk again from
    further roots, as often as the deepest level reached demands.

    Before the exact check, pairs that agree in fewer than ``low`` of the 128
    bits of their sketches, or whose sizes don't allow the similarity, are
    dropped; ``low`` is five standard deviations below the mean at the threshold.
    """
    tokens = records.where(F.size("tokens") > 0).select("cls", "tokens")
    at = stored(shared_buckets(records.select(F.explode("nodes").alias("node"), "cls")), "buckets")
    found, hot, reached, done = [], None, depth, runs
    while True:
        level = depth
        while level < deepest and at.where(F.col("size") > small).take(1):
            found.append(meetings(at.where(F.col("size") <= small)))
            large = stored(at.where(F.col("size") > small).select("node", "cls"), "large")  # its size, known now, picks the join
            if hot is None:
                one = tokens.join(large.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.first("tokens").alias("tokens"))
                hot = stored(one, "hot")
            at = stored(shared_buckets(deeper(large, hot, 2, similarity)), "buckets")
            level += 2
        found.append(meetings(at))
        reached = max(reached, level)
        wanted = runs_for(reached, runs, depth)
        if wanted <= done:
            break
        at = stored(shared_buckets(again(hot, done, wanted, depth, similarity)), "buckets")
        done = wanted
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    mean = (1 + similarity) / 2
    low = int(128 * mean - 5 * math.sqrt(128 * mean * (1 - mean)))
    sketches = records.where(F.col("s1").isNotNull()).groupBy("cls").agg(F.first("n").alias("n"), F.first("s1").alias("s1"), F.first("s2").alias("s2"))
    for side in "ab":
        pairs = pairs.distinct() if side == "a" else pairs
        pairs = pairs.join(sketches.select(F.col("cls").alias(side), F.col("n").alias(f"n{side}"), F.col("s1").alias(f"s1{side}"), F.col("s2").alias(f"s2{side}")), side)
    differ = F.bit_count(F.col("s1a").bitwiseXOR(F.col("s1b"))) + F.bit_count(F.col("s2a").bitwiseXOR(F.col("s2b")))
    fit = (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity)) & (differ <= 128 - low)
    pairs = stored(pairs.where(fit).select("a", "b"), "candidates")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    one = tokens.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("tokens").alias("tokens"))
    both = pairs.join(one.select(F.col("cls").alias("a"), F.col("tokens").alias("ta")), "a").join(one.select(F.col("cls").alias("b"), F.col("tokens").alias("tb")), "b")
    inter = F.size(F.array_intersect("ta", "tb"))
    jaccard = inter / (F.size("ta") + F.size("tb") - inter)
    return both.select("a", "b", jaccard.alias("similarity")).where(F.col("similarity") >= similarity)


def similar_rows(members: DataFrame, classes: DataFrame, block: int = 1000) -> DataFrame:
    """Expand pairs of classes, and the classes themselves, into pairs of rows ``id_a`` < ``id_b``.

    The rows of a class are cut into parts of about ``block``, so that a class that
    holds many rows meets itself, and others, in many tasks.
    """
    sizes = members.groupBy("cls").agg(F.count(F.lit(1)).alias("size"))
    parts = F.ceil(F.col("size") / block).cast("int")
    cut_up = look_up(members, sizes, "cls", F.col("id")).select("id", "cls", "size", F.pmod(F.xxhash64("id"), parts).alias("part"))
    a = cut_up.select(F.col("cls").alias("a"), F.col("id").alias("x"), F.col("part").alias("pa"), "size")
    b = cut_up.select(F.col("cls").alias("b"), F.col("id").alias("y"), F.col("part").alias("pb"))
    parts_of = lambda side: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(f"n{side}") / block) - 1))
    both = classes.select("a", "b").join(sizes.select(F.col("cls").alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col("cls").alias("b"), F.col("size").alias("nb")), "b")
    both = both.withColumn("pa", parts_of("a")).withColumn("pb", parts_of("b")).select("a", "pa", "b", "pb")
    across = both.join(a.drop("size"), ["a", "pa"]).join(b, ["b", "pb"]).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    twins = a.where(F.col("size") > 1).withColumn("pb", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    same = twins.join(b.withColumnRenamed("b", "a"), ["a", "pb"]).where(F.col("x") < F.col("y")).select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return across.union(same)


def groups(members: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per record: ``id``, ``group_id`` (its least id) and ``links`` (similar other records)."""
    sizes = stored(members.groupBy("cls").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("least")), "sizes")
    both = classes.select(F.col("a").alias("cls"), F.col("b").alias("other")).union(classes.select("b", "a"))
    links = look_up(both, sizes.select(F.col("cls").alias("other"), "rows"), "other", F.col("cls")).groupBy("cls").agg(F.sum("rows").alias("others"))
    roots = components(classes.select(F.col("a").alias("u"), F.col("b").alias("v")))
    per = sizes.join(links, "cls", "left").join(roots.withColumnRenamed("vertex", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    per = stored(per.select("cls", "least", "root", (F.coalesce("others", F.lit(0)) + F.col("rows") - 1).alias("links")), "linked")
    least = per.groupBy("root").agg(F.min("least").alias("group_id"))
    per = look_up(per, least, "root", F.col("cls")).select("cls", "group_id", "links")
    return look_up(members, per, "cls", F.col("id")).select("id", "group_id", "links")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(table(spark, sf_dir, "apply_samples").select("sample_id", "original_code", "update_snippet"))
    text = F.concat(F.coalesce("original_code", F.lit("")), F.lit("\n"), F.coalesce("update_snippet", F.lit("")))
    return stored(sets(df, "sample_id", text, RUNS, DEPTH, SIMILARITY), "sets")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    pairs = similar_rows(records.select("id", "cls"), similar_classes(records))
    return pairs.select(F.col("id_a").alias("sample_id_a"), F.col("id_b").alias("sample_id_b"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with the number of its links and its group; records without three words stand alone."""
    records = _records(spark, sf_dir)
    classes = stored(similar_classes(records), "pairs")
    every = table(spark, sf_dir, "apply_samples").select(F.col("sample_id").alias("id"))
    out = every.join(groups(records.select("id", "cls"), classes), "id", "left")
    return out.select(F.col("id").alias("sample_id"), F.coalesce("group_id", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


#: The definition for DuckDB: shingles of each text, all texts that share one compared.
SHINGLES = """
words AS (SELECT id, field, regexp_extract_all(lower(t), '[a-z0-9_]+') AS w FROM texts),
shingles AS (SELECT DISTINCT id, field, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT id, field, w, unnest(generate_series(1, len(w) - 2)) AS i FROM words WHERE len(w) > 2)),
sizes AS (SELECT id, field, count(*) AS n FROM shingles GROUP BY id, field),
shared AS (SELECT a.id AS a, b.id AS b, a.field, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.field = b.field AND a.id < b.id GROUP BY a.id, b.id, a.field),
near_pairs AS (SELECT DISTINCT a, b FROM shared s JOIN sizes x ON x.id = s.a AND x.field = s.field JOIN sizes y ON y.id = s.b AND y.field = s.field WHERE s.n >= 0.7 * (x.n + y.n - s.n) - 1e-9)
"""
_TEXTS = "texts AS (SELECT sample_id AS id, '' AS field, coalesce(original_code, '') || chr(10) || coalesce(update_snippet, '') AS t FROM apply_samples), "
_GROUPS = """,
both_ways AS (SELECT a, b FROM near_pairs UNION SELECT b, a FROM near_pairs),
reach AS (SELECT a AS node, b AS other FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON w.a = r.other)
SELECT sample_id, least(sample_id, coalesce((SELECT min(other) FROM reach WHERE node = sample_id), sample_id)) AS group_id, (SELECT count(*) FROM both_ways WHERE a = sample_id) AS links FROM apply_samples
"""

QUERIES = {
    "p6_found": (p6_found, f"WITH {_TEXTS}{SHINGLES} SELECT a AS sample_id_a, b AS sample_id_b FROM near_pairs"),
    "p6_groups": (p6_groups, f"WITH RECURSIVE {_TEXTS}{SHINGLES}{_GROUPS}"),
}

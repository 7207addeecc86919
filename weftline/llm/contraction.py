"""Connected components by random-mate contraction, in joins only.

Each round tosses a coin for every vertex that still has an edge, by a hash of
vertex and round. A tail with a neighbour that shows heads collapses into the
least such neighbour; edges are renamed, loops and repeats dropped, until no
edge is left. Each round is one table, of the edges left and the moves made, so
plans stay as small as that of one round. A vertex moves once at most, so the
moves of all rounds are a forest no deeper than there were rounds; it is
unwound by looking up where a vertex's target went, which doubles the way each
time. A vertex of very many edges is looked up by broadcast (:mod:`skew`).
Nothing is gathered on the driver but the number of edges left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stored, stored_path
from .skew import HOT, look_up


def _heads(vertex: str, turn: int) -> Column:
    return F.xxhash64(F.col(vertex), F.lit(turn)).bitwiseAND(F.lit(1)) == 1


def _undirected(u: Column, v: Column) -> list[Column]:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def _mates(left: DataFrame, turn: int) -> DataFrame:
    """``u``, ``to`` (where it moves, or null) and ``degree`` of each vertex with an edge; one shuffle."""
    both = left.union(left.select("v", "u"))
    to = F.min(F.when(~_heads("u", turn) & _heads("v", turn), F.col("v")))
    return both.groupBy("u").agg(to.alias("to"), F.count(F.lit(1)).alias("degree"))


def contract(left: DataFrame, turn: int, count: int) -> DataFrame:
    """The ``count`` edges ``left`` (u, v) after one round, and its moves: ``u``, ``v`` and ``moved``."""
    mates = _mates(left, turn)
    hot = mates.where(F.col("degree") > max(HOT, 2 * count / HOT)) if 2 * count > HOT else None
    moves = mates.where(F.col("to").isNotNull()).select("u", "to")
    for side, other in (("u", "v"), ("v", "u")):
        found = moves.withColumnRenamed("u", side)
        # too few edges for any vertex to be hot need no second join
        near = left.join(found, side, "left") if hot is None else look_up(left, found, side, F.col(other), hot.select(F.col("u").alias(side)))
        left = near.select(F.coalesce("to", side).alias(side), other)
    edges = left.where(F.col("u") != F.col("v")).select(*_undirected(F.col("u"), F.col("v"))).distinct()
    return edges.withColumn("moved", F.lit(False)).union(moves.withColumn("moved", F.lit(True)))


def components(edges: DataFrame) -> DataFrame:
    """``vertex`` and ``root`` for each vertex of ``edges`` (u, v); loops, nulls and repeats don't matter.

    Vertices are of any one comparable type. The roots are arbitrary but the
    same in every run. A table without edges gives no rows.
    """
    spark = edges.sparkSession
    every = stored(edges.where(F.col("u").isNotNull() & F.col("v").isNotNull()).select(*_undirected(F.col("u"), F.col("v"))).distinct(), "edges")
    loops = every.where(F.col("u") == F.col("v")).select(F.col("u").alias("vertex"))
    left = every.where(F.col("u") != F.col("v"))
    kind = every.schema["u"].dataType.simpleString()
    paths: list[str] = []
    while count := left.count():
        paths.append(stored_path(contract(left, len(paths), count), "round"))
        left = spark.read.schema(f"u {kind}, v {kind}, moved boolean").parquet(paths[-1]).where("not moved").select("u", "v")
    if not paths:
        return loops.select("vertex", F.col("vertex").alias("root"))
    roots = spark.read.schema(f"u {kind}, v {kind}, moved boolean").parquet(*paths).where("moved").select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    for _ in range(max(0, (len(paths) - 1).bit_length())):  # a way of as many moves as rounds
        further = roots.select(F.col("vertex").alias("root"), F.col("root").alias("next"))
        roots = stored(look_up(roots, further, "root", F.col("vertex")).select("vertex", F.coalesce("next", "root").alias("root")), "roots")
    known = stored(roots.union(roots.select("root").distinct().select(F.col("root").alias("vertex"), "root")), "components")
    return known.union(loops.join(known, "vertex", "left_anti").select("vertex", F.col("vertex").alias("root")))

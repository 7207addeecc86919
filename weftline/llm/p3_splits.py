"""Problem 3: splits that keep related records together.

Records are tied by repository (however written), by commit, and, without a
repository, by the repository their path begins with. Repositories and commits
are the vertices of a graph; each commit becomes a star of edges from its
least repository, so copies and hot repositories shrink to one edge before any
shuffle of edges. Random-mate contraction (:mod:`contraction`) finds the
components, and whole components go to train, validation or test by cumulative
weight.

Defined results: a blank repository, commit or path counts as null;
placeholders for commits (``unknown``, ``HEAD``, zeros and the like) tie
nothing; an abbreviated commit (7 or more hexadecimal digits) stands for the
full one that begins with it, if there is exactly one, else for itself; a
record without any tie is a component of its own; repeated rows are repeated;
an empty table gives no rows; other columns are dropped. A component above
``giant`` of all rows goes to train first, since it can't fit elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import stored, table
from .contraction import components
from .ranking import running_total
from .skew import hot_keys, look_up

SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def filled(c: Column) -> Column:
    return F.when(F.trim(F.regexp_replace(c, r"\s", " ")) != "", c)


def repo_name(c: Column) -> Column:
    """``owner/name`` in lower case, without scheme, host, ``.git`` and slashes; null if blank."""
    s = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    s = F.regexp_replace(s, r"^[a-z+]+://(?:[^/@]*@)?[^/]*/|^[^/@]+@[^/:]+:", "")
    s = F.regexp_replace(s, r"^/+|/+$", "")
    s = F.regexp_replace(s, r"\.git$", "")
    s = F.regexp_replace(s, r"^[^/]*\.[^/]*/(?=[^/]+/[^/]+$)", "")
    return F.when(s != "", s)


def path_repo(c: Column) -> Column:
    """The first two segments of a path, after a leading scheme, slash or host (a segment with a dot)."""
    s = F.lower(F.trim(c))
    s = F.regexp_replace(s, r"^[a-z+]+://", "")
    s = F.regexp_replace(s, r"^/+", "")
    s = F.regexp_replace(s, r"^[^/]*\.[^/]*/(?=[^/]+/[^/]+)", "")
    name = F.regexp_extract(s, r"^([^/]+/[^/]+)/", 1)
    return F.when(name != "", F.regexp_replace(name, r"\.git$", ""))


def commit_id(c: Column) -> Column:
    """Lower-case hexadecimal id of 7 to 40 (or 64) digits; null for anything else and for zeros."""
    s = F.lower(F.trim(c))
    return F.when(s.rlike(r"^(?:[0-9a-f]{7,40}|[0-9a-f]{64})$") & ~s.rlike(r"^0+$"), s)


def full_commits(ids: DataFrame) -> DataFrame:
    """``commit`` and ``full`` for each abbreviation of exactly one full id; ``ids`` has distinct ``commit``."""
    size = F.length("commit")
    short = ids.where(size < 40)
    lengths = [r[0] for r in short.select(size.alias("n")).distinct().orderBy("n").collect()]  # at most 33
    if not lengths:
        return short.select("commit", F.col("commit").alias("full"))
    begins = ids.where(size >= 40).select(F.col("commit").alias("full"), F.explode(F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.substring(F.col("commit"), F.lit(1), n))).alias("commit"))
    hit = begins.join(short, "commit").groupBy("commit").agg(F.min("full").alias("full"), F.max("full").alias("last"))
    return hit.where(F.col("full") == F.col("last")).select("commit", "full")


def keys(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """``id``, ``stored`` (repository as written, null if blank), ``repo`` (name, also by the path) and ``commit`` (full)."""
    base = df.select(F.col(key).alias("id"), filled(F.col("repo")).alias("stored"), repo_name(F.col("repo")).alias("named"), path_repo(F.col("path")).alias("by_path"), commit_id(F.col("commit")).alias("commit"))
    base = stored(base, "ties")
    names = base.where(F.col("named").isNotNull()).select(F.col("named").alias("by_path"), F.col("named").alias("known")).distinct()
    lost = base.where(F.col("named").isNull() & F.col("by_path").isNotNull()).select("by_path").distinct().join(names, "by_path")
    full = full_commits(base.where(F.col("commit").isNotNull()).select("commit").distinct())
    out = look_up(look_up(base, lost, "by_path", F.col("id")), full, "commit", F.col("id"), hot_keys(base, "commit"))
    return out.select("id", "stored", F.coalesce("named", "known").alias("repo"), F.coalesce("full", "commit").alias("commit"))


def related(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """``id``, ``stored`` and ``component``, equal for all records tied together."""
    rows = stored(keys(df, key), "rows")
    pairs = stored(rows.where(F.col("repo").isNotNull() & F.col("commit").isNotNull()).select("repo", "commit").distinct(), "pairs")
    hub = stored(pairs.groupBy("commit").agg(F.min("repo").alias("hub"), F.max("repo").alias("last")), "hubs")
    shared = hub.where(F.col("hub") != F.col("last")).select("commit", "hub")
    edges = pairs.join(shared, "commit").where(F.col("repo") != F.col("hub")).select(F.col("hub").alias("u"), F.col("repo").alias("v"))
    roots = components(edges)
    orphans = look_up(rows.where(F.col("repo").isNull()), hub.select("commit", F.col("hub").alias("vertex")), "commit", F.col("id"))
    vertex = F.coalesce("vertex", F.concat(F.lit("commit:"), F.col("commit")), F.concat(F.lit("row:"), F.col("id").cast("string")))
    placed = rows.where(F.col("repo").isNotNull()).select("id", "stored", F.col("repo").alias("vertex")).union(orphans.select("id", "stored", vertex.alias("vertex")))
    return look_up(stored(placed, "vertices"), roots, "vertex", F.col("id")).select("id", "stored", F.coalesce("root", "vertex").alias("component"))


def smallest_repo(placed: DataFrame) -> DataFrame:
    """``component`` and ``group_repo``, its smallest repository as stored, by code point."""
    return placed.where(F.col("stored").isNotNull()).groupBy("component").agg(F.min("stored").alias("group_repo"))


def assign(placed: DataFrame, shares: tuple = SHARES, giant: float = 0.01) -> DataFrame:
    """``id``, ``component`` and ``split``: whole components, by cumulative weight in the order of the md5 of their least id."""
    sizes = stored(placed.groupBy("component").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("least")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    rank = F.shiftleft(F.conv(F.substring(F.md5(F.col("least").cast("string")), 1, 15), 16, 10).cast("long"), 3)
    # giants come first, with negative ranks, and the first share is train
    summed = running_total(sizes, "weight", F.when(F.col("weight") > total * giant, rank + F.lit(-(2**63))).otherwise(rank))
    middle, split, bound = F.col("total") - F.col("weight") / 2, None, 0.0
    for name, share in shares:
        bound += share
        here = middle <= total * bound + 1e-9
        split = F.when(here, name) if split is None else split.when(here, name)
    chosen = summed.select("component", split.otherwise(shares[-1][0]).alias("split"))
    return look_up(placed, chosen, "component", F.col("id")).select("id", "component", "split")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = stored(related(table(spark, sf_dir, "apply_samples")), "placed")
    out = look_up(placed, smallest_repo(placed), "component", F.col("id")).where(F.col("group_repo").isNotNull())
    case = F.col("stored").isNull() | (F.col("stored") != F.col("group_repo"))
    return out.where(case).select(F.col("id").alias("sample_id"), "group_repo")


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(stored(related(table(spark, sf_dir, "apply_samples")), "placed"))
    return out.select(F.col("id").alias("sample_id"), "split")


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and components in each split."""
    out = assign(stored(related(table(spark, sf_dir, "apply_samples")), "placed"))
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("component").alias("components"))


#: The same definitions for DuckDB: reachability over repositories and commits instead of contraction.
_PLACED = r"""
WITH RECURSIVE lowered AS (
  SELECT sample_id AS id, CASE WHEN trim(regexp_replace(repo, '\s', ' ', 'g')) <> '' THEN repo END AS stored,
    lower(trim(regexp_replace(repo, '\s+', ' ', 'g'))) AS r, lower(trim(path)) AS p, lower(trim("commit")) AS c
  FROM apply_samples),
bare AS (
  SELECT id, stored,
    regexp_replace(regexp_replace(regexp_replace(r, '^[a-z+]+://(?:[^/@]*@)?[^/]*/|^[^/@]+@[^/:]+:', ''), '^/+|/+$', '', 'g'), '\.git$', '') AS r,
    regexp_replace(regexp_replace(regexp_replace(p, '^[a-z+]+://', ''), '^/+', ''), '^[^/]*\.[^/]*/([^/]+/[^/]+)', '\1') AS p,
    CASE WHEN regexp_matches(c, '^(?:[0-9a-f]{7,40}|[0-9a-f]{64})$') AND NOT regexp_matches(c, '^0+$') THEN c END AS c
  FROM lowered),
base AS (
  SELECT id, stored, nullif(regexp_replace(r, '^[^/]*\.[^/]*/([^/]+/[^/]+)$', '\1'), '') AS named, regexp_replace(nullif(regexp_extract(p, '^([^/]+/[^/]+)/', 1), ''), '\.git$', '') AS by_path, c
  FROM bare),
full_ids AS (
  SELECT s.c, min(f.c) AS long_id FROM (SELECT DISTINCT c FROM base WHERE length(c) < 40) s JOIN (SELECT DISTINCT c FROM base WHERE length(c) >= 40) f ON starts_with(f.c, s.c)
  GROUP BY s.c HAVING count(*) = 1),
tied AS (
  SELECT id, stored, coalesce(named, CASE WHEN by_path IN (SELECT named FROM base WHERE named IS NOT NULL) THEN by_path END) AS repo, coalesce(long_id, base.c) AS c
  FROM base LEFT JOIN full_ids ON base.c = full_ids.c),
edges AS (SELECT DISTINCT 'r:' || repo AS u, 'c:' || c AS v FROM tied WHERE repo IS NOT NULL AND c IS NOT NULL),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach AS (SELECT u AS node, u AS other FROM both_ways UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON b.u = r.other),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
vertices AS (SELECT id, stored, coalesce('r:' || repo, 'c:' || c, 'x:' || CAST(id AS VARCHAR)) AS vertex FROM tied),
placed AS (SELECT id, stored, coalesce(root, vertex) AS component FROM vertices LEFT JOIN roots ON node = vertex)
"""
_ASSIGNED = (
    _PLACED
    + """,
sizes AS (SELECT component, count(*) AS weight, CAST('0x' || substr(md5(CAST(min(id) AS VARCHAR)), 1, 15) AS BIGINT) AS rank FROM placed GROUP BY component),
summed AS (SELECT component, weight, (SELECT count(*) FROM placed) AS n, sum(weight) OVER (ORDER BY CASE WHEN weight > (SELECT count(*) FROM placed) * 0.01 THEN 0 ELSE 1 END, rank) AS total FROM sizes),
chosen AS (SELECT component, CASE WHEN total - weight / 2.0 <= n * 0.8 + 1e-9 THEN 'train' WHEN total - weight / 2.0 <= n * 0.9 + 1e-9 THEN 'validation' ELSE 'test' END AS split FROM summed)
"""
)

QUERIES = {
    "p3_found": (p3_found, _PLACED + "SELECT id AS sample_id, group_repo FROM placed JOIN (SELECT component, min(stored) AS group_repo FROM placed WHERE stored IS NOT NULL GROUP BY component) USING (component) WHERE stored IS NULL OR stored <> group_repo"),
    "p3_splits": (p3_splits, _ASSIGNED + "SELECT id AS sample_id, split FROM placed JOIN chosen USING (component)"),
    "p3_shares": (p3_shares, _ASSIGNED + 'SELECT split, count(*) AS "rows", count(DISTINCT component) AS components FROM placed JOIN chosen USING (component) GROUP BY split'),
}

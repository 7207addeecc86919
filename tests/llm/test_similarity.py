"""p5 and p6 against brute force, p3's contraction against union-find."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import contraction, p3_splits, p5_overlap, p6_near_duplicates as p6
from weftline.llm.ranking import number_within, running_total
from weftline.llm.skew import hot_keys, look_up


def shingle_set(text):
    w = re.findall(r"[a-z0-9_]+", (text or "").lower())
    return set(zip(w, w[1:], w[2:]))


def similarity(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def family(rng, n, words=60):
    """Texts with copies, small edits and strangers."""
    out = []
    while len(out) < n:
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, words))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = f"w{rng.randrange(400)}"
            out.append(" ".join(t))
    return [*out[:n], "", None, "one two", "same words here now", "same words here now", "same words here now"]


@pytest.fixture(scope="module")
def near():
    return family(random.Random(7), 150)


def test_near_duplicates(spark, near):
    df = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(near)], "sample_id long, original_code string, update_snippet string, cls string").repartition(3)
    text = F.concat(F.coalesce("original_code", F.lit("")), F.lit("\n"), F.coalesce("update_snippet", F.lit("")))
    records = p6.sets(df, "sample_id", text, p6.RUNS, p6.DEPTH, p6.SIMILARITY).cache()
    # a small bucket size makes the recursion go deeper
    got = {(r.id_a, r.id_b) for r in p6.similar_rows(records.select("id", "cls"), p6.similar_classes(records, small=3)).collect()}
    sets = [shingle_set(t) for t in near]
    want = {(i, j) for i, j in combinations(range(len(near)), 2) if similarity(sets[i], sets[j]) >= 0.7}
    assert got == want
    grouped = p6.groups(records.select("id", "cls"), p6.similar_classes(records)).collect()
    links = {i: sum(i in p for p in want) for i in range(len(near)) if sets[i]}
    assert {r.id: r.links for r in grouped} == links
    assert all(r.group_id <= r.id for r in grouped)
    records.unpersist()


def test_miss_probability():
    assert p6.missed(0.7) < 1e-4 and p6.missed(0.85) < 1e-5
    nodes = p6.walk(np.array([1, 2], np.uint64), np.array([5], np.uint32), 2, 0.7)
    assert len(nodes) == 2  # a set of one token always walks on


def test_pairs_of_large_buckets(spark):
    assert all(p6.missed(0.7) + p6.missed(0.7, runs=p6.runs_for(d), depth=d) < 1.001 * p6.LOST for d in (5, 7))
    assert p6.runs_for(3) == p6.RUNS
    # pairs at the threshold itself, all in buckets that are split to the last level
    texts = [" ".join(f"p{i}w{k}" for k in range(n)) for i in range(1500) for n in (102, 72)]
    df = spark.createDataFrame(list(enumerate(texts)), "sample_id long, t string").repartition(4)
    records = p6.sets(df, "sample_id", F.col("t"), p6.RUNS, p6.DEPTH, p6.SIMILARITY).cache()
    got = {(r.id_a, r.id_b) for r in p6.similar_rows(records.select("id", "cls"), p6.similar_classes(records, small=1)).collect()}
    assert got <= {(2 * i, 2 * i + 1) for i in range(1500)} and len(got) >= 1499
    records.unpersist()


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "sample_id long, t string")
    records = p6.sets(df, "sample_id", F.col("t"), 4, 2, 0.7)
    assert p6.similar_rows(records.select("id", "cls"), p6.similar_classes(records)).count() == 0


def test_overlaps(spark):
    texts = family(random.Random(9), 120)
    splits = ["train", " TRAIN", "test", "Validation ", "other", None]
    rows = [(i, (splits[i % 6], t), (texts[-i],)) for i, t in enumerate(texts)]
    schema = "row_id long, extra_info struct<split:string,original_code:string>, reward_model struct<ground_truth:string>"
    records = p5_overlap.texts(p5_overlap.flat(spark.createDataFrame(rows, schema))).cache()
    got = {(r.evaluation, r.training, r.field) for r in p5_overlap.row_overlaps(records).collect()}
    want = set()
    for (i, a, b), (j, c, d) in ((x, y) for x in rows for y in rows):
        if (a[0] or "").strip().lower() in ("test", "validation") and (c[0] or "").strip().lower() == "train":
            for field, x, y in (("original_code", a[1], c[1]), ("ground_truth", b[0], d[0])):
                if similarity(shingle_set(x), shingle_set(y)) >= 0.7:
                    want.add((i, j, field))
    assert got == want and want
    records.unpersist()


def test_overlaps_with_frequent_passages(spark, monkeypatch):
    # a third of all texts share most passages: those are ordered last, and split where they are joined
    monkeypatch.setattr(p5_overlap, "PART", 5)
    rng = random.Random(4)
    common = [f"c{k}" for k in range(30)]
    texts = [" ".join([*common, *(f"r{rng.randrange(9)}" for _ in range(rng.randrange(14)))]) for _ in range(60)] + [" ".join(common)] * 20 + family(rng, 60)
    rows = [(i, (("train", "test")[i % 2], t), (None,)) for i, t in enumerate(texts)]
    records = p5_overlap.texts(p5_overlap.flat(spark.createDataFrame(rows, "row_id long, extra_info struct<split:string,original_code:string>, reward_model struct<ground_truth:string>").repartition(3))).cache()
    got = [(r.evaluation, r.training) for r in p5_overlap.row_overlaps(records).collect()]
    sets = [shingle_set(t) for t in texts]
    want = {(i, j) for i in range(1, len(texts), 2) for j in range(0, len(texts), 2) if similarity(sets[i], sets[j]) >= 0.7}
    assert set(got) == want and len(got) == len(want) > 900
    assert p5_overlap.row_overlaps(records.limit(0)).count() == 0
    records.unpersist()


def test_summaries_are_bounded(monkeypatch):
    monkeypatch.setattr(p5_overlap, "HOT", 50)
    monkeypatch.setattr(p5_overlap, "SUMMARY", 200)
    counts, rng = p5_overlap.Frequent(), np.random.default_rng(2)
    for k in range(300):
        counts.add(np.unique(np.concatenate([np.arange(5, dtype=np.uint64), rng.integers(10, 2**60, 40).astype(np.uint64)])))
    counts.fold()
    assert len(counts.keys) <= 50 and all(counts.times[counts.keys == k] == 300 for k in range(5))


def test_coverage():
    hit = list(p5_overlap.scan([(1, "a b c d e f"), (2, "x y z")], iter([(7, "a b c d e q"), (8, "x y z")]), 0.4))
    assert [(e, t) for e, t, *_ in hit] == [(1, 7), (2, 8)]
    assert hit[0][2] == pytest.approx(3 / 5) and hit[0][3] == pytest.approx(5 / 6) and hit[1][2:] == (1.0, 1.0)
    assert list(p5_overlap.scan([], iter([(1, "a b c")]), 0.7)) == []


def test_coverage_by_all_training_texts(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(1, "train", long), (2, "train", "a b c d"), (3, "train", "e f g h"), (4, "test", " ".join(f"w{i}" for i in range(50, 80))), (5, "test", "a b c d e f g h x y"), (6, "test", "no such words here"), (7, "test", "two words")]
    df = spark.createDataFrame([(i, (s, t), (None,)) for i, s, t in rows], "row_id long, extra_info struct<split:string,original_code:string>, reward_model struct<ground_truth:string>")
    got = {r.evaluation: r.coverage for r in p5_overlap.row_coverage(p5_overlap.texts(p5_overlap.flat(df))).collect()}
    assert got == {4: 1.0, 5: 0.8, 6: 0.0}


def test_components(spark):
    random.seed(11)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(5, 5), (1, 2), (1, 2)] + [(100, 100 + k) for k in range(1, 9)] + [(300, 300)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    got = dict(map(tuple, contraction.components(spark.createDataFrame([*edges, (None, 3)], "u long, v long")).collect()))
    assert set(got) == {x for e in edges for x in e}
    for a in got:
        for b in got:
            assert (got[a] == got[b]) == (find(a) == find(b))
    assert contraction.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_long_path(spark):
    # planning must not grow with the rounds: a path of 10,000 vertices takes more than 30 of them
    n = 10_000
    made = []
    plain = contraction.contract
    contraction.contract = lambda *a: made.append(plain(*a)) or made[-1]
    try:
        got = contraction.components(spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
        assert got.count() == n and got.select("root").distinct().count() == 1
    finally:
        contraction.contract = plain
    sizes = [len(d._jdf.queryExecution().optimizedPlan().toString()) for d in (made[0], made[-1])]
    assert len(made) > 20 and sizes[1] < 1.2 * sizes[0]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 4


def test_hot_hub(spark):
    # one vertex has a third of all edges
    edges = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("u"), (F.col("id") + 1).alias("v"))
    got = contraction.components(edges)
    assert got.count() == 6001 and got.select("root").distinct().count() == 1


def test_look_up(spark):
    rows = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 1000)).alias("k"))
    found = spark.createDataFrame([("hot", 1), ("k7", 2), ("no", 3)], "k string, v int")
    got = {r.id: r.v for r in look_up(rows, found, "k", F.col("id")).collect()}
    assert len(got) == 9000 and all(v == (1 if i % 3 == 0 else 2 if i % 3 == 1 and i % 1000 == 7 else None) for i, v in got.items())
    assert look_up(rows.limit(0), found, "k", F.col("id")).count() == 0
    assert {r.k for r in hot_keys(rows, "k").collect()} == {"hot"}


SAMPLES = [
    (1, "Own/Repo", "a" * 40, "x.py"), (2, "https://git.example/own/repo.git", None, None), (3, None, "a" * 40, "src/x"), (4, " ", "A" * 12, None), (5, "fork/repo", "b" * 40, None), (6, None, "b" * 7, None),
    (7, None, None, "/own/repo/src/a.py"), (8, None, None, "git.example/fork/repo/b.py"), (9, None, None, "no/such/repo.py"), (10, None, "HEAD", None), (11, "lone/wolf", "0" * 40, None), (12, None, "unknown", ""), (13, "fork/repo/", "c" * 40, None), (14, "LONE/WOLF", "d" * 40, None), (14, "LONE/WOLF", "d" * 40, None),
]


def test_related_records(spark):
    df = spark.createDataFrame([(*r, "clash") for r in SAMPLES], "sample_id long, repo string, commit string, path string, component string")
    placed = p3_splits.related(df).cache()
    of = {}
    for r in placed.collect():
        of.setdefault(r.component, set()).add(r.id)
    assert sorted(map(sorted, of.values())) == [[1, 2, 3, 4, 7], [5, 6, 8, 13], [9], [10], [11, 14], [12]]
    least = {min(of[r.component]): r.group_repo for r in p3_splits.smallest_repo(placed).collect()}
    assert least == {1: "Own/Repo", 5: "fork/repo", 11: "LONE/WOLF"}
    split = p3_splits.assign(placed).collect()
    assert len(split) == len(SAMPLES) and len({(r.component, r.split) for r in split}) == len(of)
    assert p3_splits.related(df.limit(0)).count() == 0
    placed.unpersist()


def test_shares(spark):
    rows = spark.range(3000).select(F.col("id"), F.lit(None).cast("string").alias("stored"), F.when(F.col("id") < 1000, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 500).cast("string"))).alias("component"))
    got = {r.split: r["count"] for r in p3_splits.assign(rows).groupBy("split").count().collect()}
    assert got["train"] == pytest.approx(2400, abs=40) and got["validation"] == pytest.approx(300, abs=40) and got["test"] == pytest.approx(300, abs=40)
    assert p3_splits.assign(rows).where("component = 'hot'").select("split").distinct().collect()[0].split == "train"


def test_ranking(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("k")).withColumn("k", F.when(F.col("id") < 300, 0).otherwise(F.col("k")))
    got = number_within(df, "k", ["id"]).collect()
    for k in {r.k for r in got}:
        assert sorted(r.nth for r in got if r.k == k) == list(range(sum(r.k == k for r in got)))
    total = running_total(df.withColumn("w", F.lit(2)), "w", F.xxhash64("id")).collect()
    assert sorted(r.total for r in total) == list(range(2, 1001, 2))

"""Joins, votes, samples, batches, classification and reports against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.operators import batching, classify, filters, joins, records, reports, sampling, votes


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_votes(spark):
    random.seed(4)
    data, models = [], 6
    for g in "abcde":
        for i in range(40):
            for m in range(models):
                data.append((g, i, str(m), float(random.random() < random.random())))
    df = spark.createDataFrame(data, "language string, index long, model string, score double")
    counts = votes.counts(df)
    want = Counter((g, i) for g, i, _, s in data if s == 0)
    assert rows(counts) == sorted(((g, i, n) for (g, i), n in want.items()), key=str)
    for least in (1, 3, 5, 9):
        got = dict(rows(votes.thresholds(votes.histogram(counts), df.groupBy("language").agg(F.countDistinct("model").alias("models")), least)))
        for g in "abcde":
            hist = Counter(n for (h, _), n in want.items() if h == g)
            top = max(hist, default=0)
            t = max(1, min(least - 1, top))
            while t < top and hist[t] > hist[t + 1]:
                t += 1
            assert got[g] == min(t, models)


def test_thresholds_without_errors(spark):
    models = spark.createDataFrame([("a", 5), ("b", 0)], "language string, models long")
    hist = spark.createDataFrame([("b", 1, 2)], "language string, votes long, samples long")
    assert rows(votes.thresholds(hist, models, 5)) == [("a", 5), ("b", 5)]


@pytest.mark.parametrize("sizes", [[], [10], [6, 4, 1, 9, 2, 2, 7], [99, 1, 99], [5, 5, 5, 5]])
def test_token_batches(spark, sizes):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate(sizes)], "g string, i long, n long")
    got = rows(batching.token_batches(df, "g", "i", "n", 10))
    batch, used, want = 1, 0, []
    for i, n in enumerate(sizes):
        if used and used + n > 10:
            batch, used = batch + 1, 0
        used += n
        want.append(("g", i, n, batch))
    assert got == sorted(want, key=str)


def test_token_batches_in_ranges(spark):
    df = spark.createDataFrame([("g", i, 4) for i in range(40)], "g string, i long, n long")
    got = [r.batch for r in batching.token_batches(df, "g", "i", "n", 10, rows=10).orderBy("i").collect()]
    assert got[0] == 1 and all(b - a in (0, 1) for a, b in zip(got, got[1:])) and max(Counter(got).values()) == 2


def test_token_batches_are_the_same_in_ranges(spark):
    rng = random.Random(8)
    data = [(g, i, rng.choice([0, 0, 1, 2, 3, 4, 9, 10, 11, 25, 0])) for g, n in (("a", 150), ("b", 3), ("c", 80), (None, 40)) for i in range(n)] + [("d", i, 0) for i in range(20)] + [("e", i, 1) for i in range(60)]
    want = []
    for g in ("a", "b", "c", None, "d", "e"):
        batch, used = 1, 0
        for _, i, n in (r for r in data if r[0] == g):
            if used and used + n > 10:
                batch, used = batch + 1, 0
            used += n
            want.append((g, i, n, batch))
    df = spark.createDataFrame(data, "g string, i long, n long").repartition(3)
    for least in (7, 50, 1_000_000):
        assert rows(batching.token_batches(df, "g", "i", "n", 10, rows=least)) == sorted(want, key=str)


def test_ranks(spark):
    df = spark.createDataFrame([(None if i % 9 == 0 else "a" if i % 3 else "b", i) for i in range(300)], "g string, id long")
    got = sampling.ranked(df, "g", "id").collect()
    for g in (None, "a", "b"):
        own = [r for r in got if r.g == g]
        assert sorted(r._rank for r in own) == list(range(1, len(own) + 1))
    assert len(got) == 300


def test_intervals(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 7, 8), ("b", 0, 9), ("b", 2, 3)], "k string, s long, e long")
    assert rows(batching.merge_intervals(df, "k", "s", "e")) == [("a", 1, 5), ("a", 7, 8), ("b", 0, 9)]


def test_samples(spark):
    df = spark.createDataFrame([(g, i) for g in "ab" for i in range(20)], "language string, id long")
    quota = spark.createDataFrame([("a", 5, 3), ("c", 1, 1)], "language string, n long, test long")
    assert sampling.by_quota(df, quota.select("language", "n"), "language", "id").count() == 5
    ids = spark.createDataFrame([("a" if i < 20 else "b", i) for i in range(40)], "language string, id long")
    split = sampling.test_first(ids, quota, "language", "id")
    assert rows(split.groupBy("split").count()) == [("test", 3), ("train", 17)]
    assert rows(sampling.share_per_group(ids, "language", "id", 0.11).groupBy("language").count()) == [("a", 3), ("b", 3)]


def test_joins(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "id long, v string, w long")
    b = spark.createDataFrame([(2, None, "n"), (3, "z", "m")], "id long, v string, u string")
    assert rows(joins.upsert(a, b, "id")) == [(1, "x", 1, None), (2, "y", 1, "n"), (3, "z", None, "m")]
    c = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "id long, v string, t long")
    assert rows(joins.last_per_key(c, ["id"], ["t"])) == [(1, "b", 2), (2, "c", 1)]
    assert rows(joins.pending(a.select("id"), spark.createDataFrame([(1, " "), (2, "ok"), (2, None)], "id long, o string"), "id", "o")) == [(1,)]
    assert rows(joins.complete(a, b.select("id", "u"), on="id", needed=["v"])) == [(2, "y", 1, "n")]


def test_validation(spark):
    df = spark.createDataFrame([("a", " ", None)], "x string, y string, z string")
    assert filters.violations(df, ["x", "z", "q"], ["y", "z"]).first().violations == ["missing z", "missing q", "blank y"]


def test_commits(spark):
    text = "\n".join(f"line number {i}" for i in range(60))
    data = [("f", "f", text, text + "\nmore", "a long subject"), ("f", "g", text, text, "a long subject"), ("f", "f", text, None, "a long subject"), ("f", "f", text, text, "short"), ("f", "f", text, text[:50], "a long subject"), ("f", "f", text, "1\n" * 60, "a long subject")]
    df = spark.createDataFrame(data, "o string, n string, a string, b string, s string")
    assert filters.commits(df, "a", "b", "s", "o", "n").count() == 1


def test_gate_and_rules(spark):
    df = spark.createDataFrame([("<update_file>a</update_file>",), ("a",), ("x<update_file>a\n# ...</update_file><update_file>",), (None,)], "p string")
    got = [r[0] for r in df.select(classify.gate("p")).collect()]
    assert got[0] == [] and got[1] == ["wrapper_missing_or_truncated", "wrapper_count_abnormal"] and got[3] == got[1]
    assert got[2][:4] == ["wrapper_count_abnormal", "extra_text_outside_wrapper", "placeholder_leakage", "placeholder: # ..."] or "placeholder_leakage" in got[2]
    reply = spark.createDataFrame([('x {"verdict":"CORRECT","confidence":2,"key_points":["k"]} y',), ("no",)], "r string").select(classify.judge_reply("r").alias("j")).select("j.*").collect()
    assert tuple(reply[0]) == ("correct", 1.0, "k", None) and reply[1].error == "judge_json_parse_failed"


def test_records(spark):
    df = spark.createDataFrame([(None, "y", 3)], "lang string, language string, id long")
    value, name = records.resolve(df, "language", ("lang", "language"))
    assert tuple(df.select(value, name).first()) == ("y", "language")
    assert df.select(records.split_id(F.lit("c++-12"))["language"], records.split_id(F.lit("c++-12"))["row"]).first()[:] == ("c++", 12)
    chat = df.select(records.user_message(records.messages("s", F.lit("u")))).first()[0]
    assert chat == "u"


def test_reports(spark):
    df = spark.createDataFrame([("a", "m", 1.0), ("a", "m", 0.0), ("b", "n", 1.0)], "language string, model string, score double")
    assert rows(reports.pivot(df, ["m", "n"])) == [("Average", 0.5, 1.0), ("a", 0.5, None), ("b", None, 1.0)]
    lines = reports.markdown(reports.pivot(df, ["m", "n"]), "language", ["m", "n"]).orderBy("part", "name").collect()
    assert [r.line for r in lines] == ["| language | m | n |", "|---|---|---|", "| a | 50.00% |  |", "| b |  | 100.00% |", "| Average | 50.00% | 100.00% |"]
    empty = spark.createDataFrame([], "error_type string")
    assert {r.ratio for r in reports.error_ratios(empty, classify.error_types(spark)).collect()} == {0.0}

"""Judge records, replies on error classes, votes by count, and readers of large or faulty files."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import compare, diffs
from weftline.operators import classify, judge, votes
from weftline.operators.batching import merge_intervals
from weftline.plans import pipeline
from weftline.runtime import checkpoint_dir, clear, stored
from weftline.sources import readers

COLUMNS = (
    "judge_input_file judge_input_line judge_result judge_confidence judge_reason judge_key_points judge_matches_ground_truth judge_requested_change_applied judge_model judge_elapsed_time_s judge_used_llm judge_error "
    "judge_output_invalid judge_output_invalid_reasons judge_rule_score judge_signals judge_extracted_field_names"
).split()


@pytest.fixture
def predictions(spark):
    w = "<update_file>{}</update_file>".format
    rows = [
        (1, "a.jsonl", 1, "markdown", "x\n", "s", "y\n", w("y\n"), "no json"), (2, "a.jsonl", 2, "markdown", "x\n", "s", "y\n", "y\n", '{"verdict": "correct", "reason": "r"}'), (3, "a.jsonl", 3, None, "x\n", None, "y\n", w("z\n"), "{}"),
        (4, "a.jsonl", 4, "markdown", "x\n", "s", "y\n", w("z\n"), '{"verdict": "incorrect", "confidence": 0.7, "reason": "wrong", "key_points": ["k"], "matches_ground_truth": false, "requested_change_applied": true}'), (5, "a.jsonl", 5, "markdown", "x\n", "s", "y\n", w("z\n"), None),
    ]
    return spark.createDataFrame(rows, "sample_id long, source_file string, line_no long, language string, original_code string, update_snippet string, ground_truth string, prediction_raw string, reply string")


def test_judge_records(predictions):
    got = {r.sample_id: r for r in judge.records(predictions, "reply", model="m").collect()}
    assert all(list(r.asDict())[-17:] == COLUMNS for r in got.values())
    r = got[1]  # the judge's reply can't be read, the rules accept
    assert (r.judge_result, r.judge_confidence, r.judge_used_llm, r.judge_error, r.judge_matches_ground_truth, r.judge_requested_change_applied) == ("correct", 0.95, True, "judge_json_parse_failed", True, True) and r.judge_reason == judge.EXACT
    r = got[2]  # the judge decides even about an invalid output
    assert (r.judge_result, r.judge_output_invalid, r.judge_output_invalid_reasons[0], r.judge_error) == ("correct", True, "wrapper_missing_or_truncated", None)
    r = got[3]
    assert (r.judge_result, r.judge_confidence, r.judge_used_llm, r.judge_reason) == ("needs_review", 0.0, False, judge.MISSING + "update_snippet") and r.judge_matches_ground_truth is None
    r = got[4]
    assert (r.judge_result, r.judge_confidence, r.judge_reason, r.judge_key_points, r.judge_matches_ground_truth, r.judge_requested_change_applied) == ("incorrect", 0.7, "wrong", ["k"], False, True)
    assert (got[5].judge_result, got[5].judge_confidence, got[5].judge_error) == ("needs_review", 0.2, "empty_llm_response")
    signals = json.loads(got[4].judge_signals)
    assert signals["feature_summary"]["expected_edit_count"] == 1 and signals["prediction_wrapper"]["start_tag_count"] == 1 and got[4].judge_model == "m"


def test_judge_dry_run(predictions):
    got = {r.sample_id: r for r in judge.records(predictions, "reply", dry=True).collect()}
    assert not any(r.judge_used_llm for r in got.values()) and got[1].judge_confidence == 0.8 and got[5].judge_reason == judge.DRY and got[2].judge_result == "incorrect"
    assert judge.records(predictions.limit(0)).count() == 0


def test_compact_summary(spark):
    text = [f"line number {i}" for i in range(40)]
    truth, other = list(text), list(text)
    for i in range(0, 40, 5):
        truth[i] = f"edit of {i}"
    other[32:34] = ["stray one"]
    df = spark.createDataFrame([("\n".join(text), "\n".join(truth), "\n".join(other))], "a string, b string, c string")
    f = df.select(diffs.compact(diffs.diff_features("a", "b", "c")).alias("s")).first().s
    assert f.expected_edit_count == 8 and [e.id for e in f.expected_edits_preview] == [0, 1, 2, 3, 4] and f.expected_edits_preview[1].new == ["edit of 5"] and len(f.side_effect_opcodes_preview) <= 10


def test_votes_by_count(spark):
    df = spark.createDataFrame([("go", i, 5) for i in range(70)] + [("go", 100, 3), (None, 7, 4)], "language string, index long, votes long")
    got = {(r.language, r.votes): r for r in votes.by_votes(df, 8).collect()}
    assert got["go", 5].samples == 70 and got["go", 5].shown == list(range(50)) and got["go", 5].share == 62.5 and got["go", 3].shown is None
    assert len({(r.language, r.votes): r for r in votes.by_votes(df, 8, shown=0).collect()}["go", 5].shown) == 70
    assert votes.by_votes(df.limit(0), 0).count() == 0


def test_rubric(spark):
    assert {r.error_type for r in classify.error_types(spark, rubric=True).where("meaning <> ''").collect()} == set(classify.ERRORS)


def test_late_bad_line(spark, tmp_path):
    good, bad = tmp_path / "good one.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"a": 1}\n' * 50)
    bad.write_text('{"a": 1}\n' * 50 + '{"a": \n')
    df, errors = readers.load_all(spark, [str(good), str(bad)], "a long")
    assert df.count() == 50 and errors == {str(bad): "1 lines are no JSON"}


def test_numbers_across_blocks(spark, tmp_path):
    path = tmp_path / "long.jsonl"
    path.write_text("".join(f'{{"a": {i}}}\n' + ("\n" if i % 3 == 0 else "") for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.lines(spark, str(path)).orderBy("line_no").collect()
        want = [n for n, x in enumerate(path.read_text().split("\n"), 1) if x]
        assert [r.line_no for r in rows] == want and [json.loads(r.line)["a"] for r in rows] == list(range(3000))
        part = json.dumps({"extra_info": {"original_code": "o", "update_snippet": "s", "language": "go"}, "reward_model": {"ground_truth": "g"}})
        (tmp_path / "t.jsonl").write_text((part + "\n") * 300)
        assert sorted(r["index"] for r in readers.samples(spark, str(tmp_path / "t.jsonl")).collect()) == list(range(300))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


#: (language, prediction, truth, equal): golden rows of the comparisons.
GOLDEN = [
    ("json", '{"a": 1, "b": [true]}', '{"b": [1], "a": 1.0}', 1.0), ("json", '{"a": 1}', '{"a": 2}', 0.0), ("json", "{oops", "{oops ", 1.0), ("json", '{"a": 1, "a": 2}', '{"a": 2}', 1.0), ("yaml", "a: [1, 2]\n", "a:\n- 1\n- 2\n", 1.0), ("yaml", "a: 2024-02-31\n", "a: 2024-02-31", 1.0), ("yaml", "a: 1", "a: '1'", 0.0),
    ("xml", '<a y="2" x="1"> t </a>', '<a x="1" y="2">t</a>', 1.0), ("xml", "<a><b/>tail</a>", "<a><b/></a>", 1.0), ("xml", "<a><b/><c/></a>", "<a><c/><b/></a>", 0.0), ("ini", "[s]\na = 1\n[t]\nb=2\n", "[t]\nb = 2\n[s]\na=1\n", 1.0), ("ini", "[s]\na = 50%\n", "[s]\na = 50% \n", 1.0), ("ini", "[s]\na=1\n", "[s]\na=2\n", 0.0),
    ("python", "if a:\n    b( 1 )\n", "if a:\n  b(1)\n", 1.0), ("python", "a = 1 # x\n", "a = 1 # y\n", 0.0), ("java", "int a=1;", "int a = 1 ;", 1.0), ("markdown", "a  \n\n\n\nb", "a\n\nb\n", 1.0), ("sql", "SELECT  a\nFROM t", "select a from T", 1.0), ("sql", "select a", "select b", 0.0), (None, " a ", "a", 1.0), ("klingon", "a", "b", 0.0), ("python", None, "a", 0.0), ("python", "a", None, 0.0),
]


def test_golden_scores(spark):
    if compare.yaml is None or compare.get_lexer_by_name is None:
        pytest.skip("needs PyYAML and Pygments")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(GOLDEN)], "id int, language string, p string, t string, want double")
    got = {r.id: r.score for r in compare.score(df, "p", "t", "language").collect()}
    assert [(GOLDEN[i], s) for i, s in sorted(got.items()) if s != GOLDEN[i][3]] == []


def test_limiter_and_transports():
    now, slept = [0.0], []
    limiter = pipeline.Limiter(2, 10.0, clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(5):
        limiter.wait()
    assert slept == [10.0, 10.0]
    calls, waits = [], []

    def broken(prompt, most):
        calls.append("broken")
        yield "half"
        raise OSError

    assert pipeline.ask("p", 3, [broken, lambda p, m: iter(["a", "b"])], 2, lambda n: 1.0) == "ab" and calls == ["broken"]
    assert pipeline.ask("p", 3, [broken, lambda p, m: None], 2, lambda n: n + 1.0, sleep=waits.append) is None and len(calls) == 4 and waits == [1.0, 2.0]
    assert pipeline.ask("p", 3, [], 0, lambda n: 1.0) is None


def test_limited_responder(spark):
    requests = spark.createDataFrame([(str(i), "q", 5) for i in range(6)], "custom_id string, user_prompt string, max_tokens long")
    got = pipeline.batched_responder(lambda p, m: None, lambda p, m: [p, str(m)], retries=0, rate=(100, 1.0), partitions=3)(requests)
    assert sorted(map(tuple, got.collect())) == [(str(i), "q5") for i in range(6)]


def test_intervals_of_a_hot_key(spark):
    import random

    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 7}", s := rng.randrange(20_000), s + rng.randrange(9)) for i in range(4000)] + [("far", 0, 10**6)] + [("far", i, i + 1) for i in range(5, 4000, 9)] + [(None, 1, 2), (None, 2, 3)]
    df = spark.createDataFrame(rows, "k string, s long, e long").repartition(5)
    want = set()
    for k in {r[0] for r in rows}:
        at = None
        for s, e in sorted((s, e) for q, s, e in rows if q == k):
            if at and s <= at[1]:
                at[1] = max(at[1], e)
            else:
                if at:
                    want.add((k, *at))
                at = [s, e]
        want.add((k, *at))
    got = [tuple(r) for r in merge_intervals(df, "k", "s", "e").collect()]
    assert set(got) == want and len(got) == len(want)
    assert merge_intervals(df.limit(0), "k", "s", "e").count() == 0


def test_clear(spark):
    df = stored(spark.range(5), "short")
    assert df.count() == 5 and clear(spark) >= 1 and clear(spark) == 0
    assert not glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/weftline-short-*")

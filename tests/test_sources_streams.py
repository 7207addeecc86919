"""Readers, sinks, the chunked stripper and the pipeline."""

import json
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from weftline.plans import pipeline
from weftline.sources import readers, sinks
from weftline.streaming.tags import Reorder, TagStripper, carried, sse, stripped_batch, stripped_stream


def write(path, lines):
    path.write_text("\n".join(lines), encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", ['﻿{"a": 1, "b": "x"}', "", "oops", "[1]", '{"a": 2}'])
    got = readers.strict_jsonl(spark, path, "a long, b string").orderBy("line_no").collect()
    assert [(r.line_no, r.error, r.a, r.b) for r in got] == [(1, None, 1, "x"), (3, "input_json_parse_error", None, None), (4, "input_json_not_object", None, None), (5, None, 2, None)]
    good = write(tmp_path / "b.jsonl", ['{"a": 1}', "oops", '{"a": 2}'])
    assert sorted(r.a for r in readers.lenient_jsonl(spark, good, "a long").collect()) == [1, 2]
    with pytest.raises(ValueError):
        readers.load(spark, "x.txt")


def test_union_of_readable_files(spark, tmp_path):
    a = write(tmp_path / "a.jsonl", ['{"a": 1}'])
    b = write(tmp_path / "b.jsonl", ["nonsense"])
    df, errors = readers.load_all(spark, [a, b, str(tmp_path / "missing.parquet")], "a long")
    assert df.count() == 1 and set(errors) == {b, str(tmp_path / "missing.parquet")}


def test_discovery(spark, tmp_path):
    (tmp_path / "x").mkdir()
    write(tmp_path / "x" / "cplusplus.jsonl", ["{}"])
    write(tmp_path / "c++.csv", ["a"])
    write(tmp_path / "other.csv", ["a"])
    assert [os.path.basename(p) for p in readers.discover(spark, str(tmp_path), "c++")] == ["c++.csv", "cplusplus.jsonl"]
    write(tmp_path / "m_java_20240102_030405.jsonl", ["{}"])
    assert readers.newest_first(spark, str(tmp_path), "m_").first().language == "java"


def test_results_and_labels(spark, tmp_path):
    path = write(tmp_path / "r.json", [json.dumps({"m": {"f": {"language": "go", "errors_list": [1, 2], "Accuracy": 0.5}}})])
    assert tuple(readers.results(spark, path, "m").first()) == ("f", "go", [1, 2], 0.5)
    with pytest.raises(KeyError):
        readers.results(spark, path, "n")
    assert readers.labelled(["a/x_judged.jsonl", "b/yy1.jsonl"], {"x": "X", "yy": "Y"}) == {"a/x_judged.jsonl": "X", "b/yy1.jsonl": "Y"}
    with pytest.raises(ValueError):
        readers.labelled(["a/x.jsonl", "b/x.jsonl"], {})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, "é", "go", i % 2) for i in range(20)], "index long, t string, language string, batch int")
    sinks.jsonl_batches(df, str(tmp_path / "k"))
    assert spark.read.json(str(tmp_path / "k")).count() == 20
    sinks.ordered(df, str(tmp_path / "o"))
    files = sorted(p for p in os.listdir(tmp_path / "o") if p.startswith("part"))
    seen = [json.loads(x)["index"] for f in files for x in open(tmp_path / "o" / f, encoding="utf-8")]
    assert seen == list(range(20))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.once(df, str(tmp_path / "o"))
    sinks.by_language(df, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).where("language = 'go'").count() == 20


def test_stripper_does_not_depend_on_chunks():
    random.seed(1)
    parts = ["<update_file>", "</update_file>", "<", "<update", "a", "\n", "</upd", ">", "file>", "<<"]
    for _ in range(1500):
        text = "".join(random.choice(parts) for _ in range(random.randrange(12)))
        want = re.sub("<update_file>|</update_file>", "", text)
        cuts = sorted(random.randrange(len(text) + 1) for _ in range(random.randrange(5)))
        s, out = TagStripper(), ""
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            out += s.feed(text[a:b])
        assert out + s.flush() == want


def test_reorder():
    order = Reorder()
    assert order.push(1, "b") == [] and order.push(0, "a") == ["a", "b"] and order.push(0, "x") == [] and order.push(2, "c") == ["c"]


def test_events(spark):
    df = spark.createDataFrame([(1, 0, 'data: {"id":"i","choices":[{"delta":{"content":"x"}}]}'), (1, 1, "data: [DONE]"), (1, 2, ": ping"), (1, 3, "data: {bad")], "r long, s long, line string")
    got = df.select("r", "s", sse("line").alias("e")).orderBy("s").collect()
    assert got[0].e.content == "x" and got[1].e.done and got[2].e is None and got[3].e is None
    kept = carried(df.select("r", "s", sse("line")["id"].alias("id")), "r", "s", ["id"]).orderBy("s").collect()
    assert [r.id for r in kept] == ["i"] * 4


def test_stream_equals_batch(spark, tmp_path):
    random.seed(2)
    data = []
    for r in range(6):
        text = "<update_file>" + "".join(random.choice(["ab", "<", "\n", "</update_file>"]) for _ in range(30)) + "</update_file>"
        chunks = [text[i : i + 5] for i in range(0, len(text), 5)]
        data += [(f"r{r}", k, c, k == len(chunks) - 1) for k, c in enumerate(chunks)]
    want = dict(map(tuple, stripped_batch(spark.createDataFrame(data, "request_id string, seq long, chunk string, done boolean")).collect()))
    random.shuffle(data)
    schema = "request_id string, seq long, chunk string, done boolean"
    for k in range(3):
        spark.createDataFrame(data[k::3], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = stripped_stream(stream).writeStream.format("memory").queryName("strip").option("checkpointLocation", str(tmp_path / "cp")).start()
    # a state with timeouts asks for batches without data too, so the query is stopped when it has read all rows
    end = time.monotonic() + 120
    while sum(p["numInputRows"] for p in q.recentProgress) < len(data) and time.monotonic() < end and q.isActive:
        time.sleep(0.2)
    q.stop()
    got: dict = {}
    for r in spark.table("strip").collect():
        got[r.request_id] = got.get(r.request_id, "") + r.text
    assert got == want


def test_pipeline(spark):
    text = "\n".join(f"line number {i}" for i in range(60))
    commits = spark.createDataFrame([("go", i, "f", "f", text, text + f"\nnew {i}", f"change number {i}") for i in range(12)], "language string, row long, old_file string, new_file string, old_contents string, new_contents string, subject string")
    quota = spark.createDataFrame([("go", 10)], "language string, n long")
    split_quota = spark.createDataFrame([("go", 2)], "language string, test long")
    describe = pipeline.echo_responder(lambda p: F.lit("<change_description>adds a line</change_description>"))
    code = pipeline.echo_responder(lambda p: F.lit("<update_snippet>x</update_snippet><final_code>y</final_code>"))
    verify = pipeline.batched_responder(lambda prompt, most: "fine <Judge>PASSED</Judge>")
    results = spark.createDataFrame([("go", f"go-{i}", m, 0.0 if i == 0 else 1.0) for i in range(12) for m in "abc"], "language string, index string, model string, score double")
    out = pipeline.run(commits, quota, split_quota, describe, code, verify, results).collect()
    assert 9 <= len(out) <= 10 and "go-0" not in {r.custom_id for r in out}
    assert sum(r.extra_info.split == "test" for r in out) == 2 and out[0].reward_model.ground_truth == "y"

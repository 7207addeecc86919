"""Wrappers, tags, normal forms and small text functions."""

import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("x", "x"), ("<update_file>a", "a"), ("<update_file>a</update_file>", "a"), ("pre<update_file>a</update_file>b</update_file>post", "a</update_file>b"),
        ("</update_file>a<update_file>b", "b"), ("", ""), (None, None), ("a</update_file>b", "a"),
    ],
)
def test_wrapper_strip(spark, raw, want):
    assert one(spark, raw, T.wrapper_strip("c")) == want


@pytest.mark.parametrize(
    "raw, has_start, has_end, content, outside",
    [
        ("a", False, False, "a", ""), ("x<update_file>a</update_file> y ", True, True, "a", "x\n y"), ("<update_file>a", True, False, "a", ""), ("</update_file><update_file>b", True, False, "b", "</update_file>"), (None, False, False, "", ""),
    ],
)
def test_wrapper_parse(spark, raw, has_start, has_end, content, outside):
    r = one(spark, raw, T.wrapper_parse("c"))
    assert (r.has_start, r.has_end, r.content, r.outside) == (has_start, has_end, content, outside)


def test_tags(spark):
    c = "<t> a </t><u>x</u><t>b</t>"
    assert one(spark, c, T.tag_first("c", "t")) == "a"
    assert one(spark, "<t>open", T.tag_first("c", "t")) == "open"
    assert one(spark, "none", T.tag_first("c", "t", F.lit("ERROR"))) == "ERROR"
    assert one(spark, c, T.tag_all("c", "t")) == "a b"
    assert one(spark, "<t>open", T.tag_strict("c", "t")) == ""
    assert one(spark, c, T.tag_strict("c", "v", "u")) == "x"


def test_markers_in_order(spark):
    assert one(spark, "<update_file>\na b</think>\nc</update_file>", T.marker_clean("c")) == "a bc"
    assert one(spark, None, T.marker_clean("c")) == ""


def _reference_text(s):
    rows = [x.rstrip(" \t\f\v") for x in s.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    while rows and rows[-1] == "":
        rows.pop()
    return "\n".join(rows)


@pytest.mark.parametrize("s", ["", "a", "a  \n\nb\t\n\n", "\r\na\rb \r\n", "\n\n", "  a", "a\n \n \nb"])
def test_text_form(spark, s):
    assert one(spark, s, T.text_form("c")) == _reference_text(s)


def test_markdown_form(spark):
    assert one(spark, "\n\na  \n\n\n\nb\n", T.markdown_form("c")) == "a\n\nb"


def test_numbered(spark):
    s = "\n".join("x" * 11)
    rows = one(spark, s, T.numbered("c")).split("\n")
    assert rows[0] == " 1 | x" and rows[10] == "11 | x"
    assert one(spark, "a\nb", T.numbered("c", "label")) == "L1:a\nL2:b"
    assert one(spark, one(spark, "a\nb", T.numbered("c", "right")), T.is_numbered("c"))


@pytest.mark.parametrize("line, hit", [("# ... existing code ...", True), ("// ...", True), ("x = 1 # ...", False), ("... More  Code ...", True), ("-- ...existing code...", True)])
def test_placeholders(spark, line, hit):
    assert bool(one(spark, f"a\n{line}\nb", T.placeholders("c"))) == hit


@pytest.mark.parametrize("name, want", [("m_python_20240102_030405.jsonl", "python"), ("m_java_1.jsonl", "java"), ("x.jsonl", "python"), ("a_b.jsonl", "a")])
def test_file_language(spark, name, want):
    assert one(spark, name, T.file_language("c")) == want


def test_scalars(spark):
    assert one(spark, "Yes", T.truth("c")) is True and one(spark, "0", T.truth("c")) is False and one(spark, "?", T.truth("c")) is None
    assert one(spark, "7", T.confidence("c")) == 1.0 and one(spark, "x", T.confidence("c")) == 0.5 and one(spark, "-1", T.confidence("c")) == 0.0
    assert one(spark, " Golang ", T.language("c")) == "go" and one(spark, None, T.report_language("c")) == "unknown" and one(spark, " ", T.report_language("c")) == "unknown"
    assert re.fullmatch(r"a{5}\n.*total_chars=40.*\nb{5}", one(spark, "a" * 20 + "b" * 20, T.middle_cut("c", 10)))


def test_diff_body(spark):
    body = one(spark, "text <unified_diff>\n```diff\n@@ -1 +1 @@\n-a\n+b\n```\n</unified_diff>", T.diff_body("c"))
    assert body.error is None and body.body == "@@ -1 +1 @@\n-a\n+b\n"
    assert one(spark, "prose", T.diff_body("c")).error == "no diff found" and one(spark, " ", T.diff_body("c")).error == "empty output"

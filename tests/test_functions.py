"""Comparisons, differences and patches, on plain values."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.functions import compare as E
from weftline.functions import diffs as D
from weftline.functions import patches as P
from weftline.plans import score_queries


@pytest.mark.parametrize(
    "a, b, language, same",
    [
        ('{"a":1,"b":2}', '{"b":2, "a":1}', "json", True), ('{"a":1}', '{"a":true}', "json", True), ('{"a":1,"a":2}', '{"a":2}', "json", True), ("{", " {", "json", True), ("{", "[", "json", False),
        ("a: 1\n---\nb: 2", "a:   1\n---\nb: 2", "yaml", True), ("a: 2024-13-45", "a: 1", "yaml", False), ("a: 2024-13-45 ", "a: 2024-13-45", "yaml", True),
        ('<a x="1" y="2"/>', '<a y="2" x="1"></a>', "xml", True), ("<a><b/>tail</a>", "<a><b/>other</a>", "xml", True), ("<a>1</a>", "<a>2</a>", "xml", False), ("<a", " <a", "xml", True),
        ("[s]\na=1\nb=2", "[s]\nb = 2\na = 1", "ini", True), ("[s]\na=%", "[s]\na=%", "ini", True), ("[s]\na=%", "[s]\na =%", "ini", False), ("[DEFAULT]\na=1", "[DEFAULT]\na=2", "ini", False),
        ("if a:\n  b\nc", "if a:\n    b\nc", "python", True), ("a = 1  # x", "a = 1", "python", False), ("a  b", "a b", "unknown-language", False), (" a", "a", None, True),
    ],
)
def test_same(a, b, language, same):
    assert E.same(a, b, language) is same
    assert E.same(b, a, language) is same


lines = st.lists(st.sampled_from(["a", "b", "  c", "}", "", "def x():"]), max_size=12)


@given(lines, lines)
@settings(max_examples=150, deadline=None)
def test_diff_round_trip(a, b):
    x, y = "\n".join(a), "\n".join(b)
    patch = D.unified(x, y, 2)
    if x.splitlines() != y.splitlines():
        assert P.apply_diff(x, patch).rstrip("\n") == y.rstrip("\n")


@given(st.text("ab\n ", max_size=12), st.text("ab\n ", max_size=12))
@settings(max_examples=150, deadline=None)
def test_edit_distance(a, b):
    table = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    assert P.edit_distance(a, b) == table[len(a), len(b)]


FILE = "def f():\n    x = 1\n    return x\n\ndef g():\n    x = 1\n    return 2\n"


@pytest.mark.parametrize(
    "old, new, want",
    [
        ("return 2", "return 3", "return 3"), ("def f():\nx = 1", "def h():\n    y", "def h():\n    y"), ("def f():\n  strange\nreturn x", "pass", "pass"), ("return    2", "return 9", "return 9"),
        ("x = 1\nreturn 2", "z", "z"), ("return 2\\n", "q\n", "q"), ("\n\nreturn 2\n\n", "w", "w"),
    ],
)
def test_replace(old, new, want):
    out = P.replace(FILE, old, new)
    assert want in out and out != FILE


def test_replace_errors():
    with pytest.raises(P.PatchError, match="identical"):
        P.replace(FILE, "x", "x")
    with pytest.raises(P.PatchError, match="Could not find"):
        P.replace(FILE, "nowhere to be", "x")
    with pytest.raises(P.PatchError, match="multiple"):
        P.replace(FILE, "x = 1", "y")
    assert P.replace(FILE, "x = 1", "y", True).count("y\n") == 2


def test_edits():
    assert P.apply_edits("a\r\nb", '{"edits":[{"oldString":"a\\nb","newString":"c\\nd"}]}') == "c\r\nd"
    assert P.apply_edits("x", '[{"oldString":"","newString":"whole"}]') == "whole"
    assert P.apply_edits("x y", 'Sure: ```json\n{"oldString":"x","newString":"z"}\n```') == "z y"
    assert P.apply_edits("x y", 'noise {"k": 1} then [{"oldString":"y","newString":"z"}] end') == "x z"
    for bad, message in (("nothing", "not valid JSON"), ("3", "Unexpected patch JSON type"), ("[1]", "is not an object"), ('[{"oldString":"a"}]', "must contain")):
        with pytest.raises(P.PatchError, match=message):
            P.apply_edits("x", bad)


def test_diff_errors():
    assert P.apply_diff("a\r\nb", "no hunks") == "a\nb"
    with pytest.raises(P.PatchError, match="Empty hunk"):
        P.apply_diff("a", "@@ -1 +1 @@\n")
    with pytest.raises(P.PatchError, match="single-file"):
        P.apply_diff("a", "diff --git a b\ndiff --git c d\n")
    with pytest.raises(P.PatchError, match="no unique match"):
        P.apply_diff("a\na", "@@ -9 +9 @@\n-a\n+b\n")
    assert P.apply_diff("x\na\nb", "@@ -1,2 +1,2 @@\n-a\n+c\n b\n\\ No newline at end of file\n") == "x\nc\nb"


def test_features():
    a = "\n".join(f"line {i}" for i in range(60))
    b = a.replace("line 5\n", "line five is new\n")
    assert D.summary(a, b, b)["patch_match_score"] == 1.0 and D.summary(a, b, b)["side_effect_opcode_count"] == 0
    none = D.summary(a, b, a)
    assert none["no_op_score"] == 1.0 and none["actual_edit_count"] == 0 and none["missing"] == [0]
    far = D.summary(a, b, a + "\nline five is new")
    assert far["misplaced"] == [0] and far["side_effect_opcode_count"] == 1
    near = D.summary(a, b, a.replace("line 5\n", "   line five is new\n"))
    assert near["near_miss"] == [0] and near["missing"] == []
    assert D.merge_windows([(5, 8), (1, 3), (3, 4), (9, 9)]) == [(1, 4), (5, 8), (9, 9)]


def test_line_errors():
    assert D.line_errors("x\ny", "a\nx\nb", "a\nz\nb") == (1, 0)
    assert D.line_errors(None, "a\nb", "a\nb\nc") == (0, 1)
    assert D.line_errors("c", "a\nb", "a\nb\nc") == (1, 0)


def test_block_edits():
    a = [f"line {i}" for i in range(60)]
    b = [*a[:10], "new", *a[11:40], *a[42:]]
    edits = score_queries.block_edits("\n".join(a), "\n".join(b))
    assert [e["oldString"].split("\n") for e in edits] == [a[8:13], a[38:44]]  # two lines around each change, not the file
    rng = random.Random(6)
    for _ in range(300):  # repeated and empty lines need wider blocks
        x = [rng.choice(["", "}", "a", " a"]) for _ in range(rng.randrange(2, 40))]
        y = [v for v in x if rng.random() > 0.1 for v in ([v, rng.choice(["}", "b", ""])] if rng.random() < 0.1 else [v])]
        x, y = "\n".join(x), "\n".join(y)
        assert P.apply_edits(x, {"edits": score_queries.block_edits(x, y) if x != y else []}) == y

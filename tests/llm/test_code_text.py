"""p1, p2, p4, p7 and p10 on planted cases."""

import random
import re
import string

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.llm import p1_generated as p1, p2_pairs as p2, p4_syntax as p4, p7_credentials as p7, p10_reading as p10, trees
from weftline.llm.languages import language_of

PY = "import os\n\n\ndef f(a, b=3):\n    if a > 2:\n        return [a, b]\n    return {'x': b}\n"
JS = 'const a = require("./a");\n\nfunction f(x, y) {\n  if (x > 2) {\n    a.push(y);\n  }\n  return { k: x };\n}\n'
TS = 'import { a } from "./a";\n\nexport function f(x: number, y: string): number {\n  const z: number[] = [x, 2];\n  return z[0];\n}\n'
GO = 'package main\n\nimport "log"\n\nfunc f(a int, b string) int {\n\tc := a + 1\n\tfor i := 0; i < 3; i++ {\n\t\tlog.Printf("x", b)\n\t}\n\treturn c\n}\n'
C = '#include <stdio.h>\n\nstatic int f(int a, char *b) {\n  int c = a + 1;\n  if (c > 2) {\n    printf("x %s", b);\n  }\n  return c;\n}\n'
CPP = "#include <vector>\n\nnamespace n {\n\nint f(std::vector<int> a) {\n  auto b = a.size();\n  for (auto& x : a) {\n    b += x;\n  }\n  return b;\n}\n\n}\n"
JAVA = "package a.b;\n\nimport java.util.List;\n\npublic class X {\n  private int y;\n\n  public int f(List<String> a) {\n    this.y = a.size();\n    return y;\n  }\n}\n"
RUST = "use crate::a::B;\n\npub fn f(a: i64, b: &str) -> i64 {\n    let mut c = vec![1];\n    if a > 2 {\n        c.push(a);\n    }\n    return a;\n}\n"
SH = '#!/usr/bin/env bash\nset -eu\n\nf() {\n  local a=1\n  for i in $(seq 3); do\n    echo "x $a"\n  done\n  if [ "$a" -gt 2 ]; then\n    return 0\n  fi\n}\n'
SQL = "CREATE TABLE t (\n  id BIGINT NOT NULL,\n  v VARCHAR(30)\n);\n\nINSERT INTO t (id, v) VALUES (1, 'it''s');\nSELECT a, b FROM t WHERE (id > 3) ORDER BY a;\n"
YAML, INI, XML, JSON = "a:\n  b: 1\n  c:\n    - x\n", "[s]\na = 1\nb: two\n", '<?xml version="1.0"?>\n<a>\n  <b c="1">x</b>\n</a>\n', '{\n  "a": [1, 2],\n  "b": {"c": "x"}\n}\n'
FILES = {"python": PY, "javascript": JS, "typescript": TS, "go": GO, "c": C, "c++": CPP, "java": JAVA, "rust": RUST, "shell": SH, "sql": SQL, "yaml": YAML, "ini": INI, "xml": XML, "json": JSON}


def invalid(text, language):
    broken, pairs = p4.check(text, language)
    return broken or any(p not in p4.permitted(language) for p in pairs)


@pytest.mark.parametrize("language", FILES)
def test_valid_files(language):
    assert not invalid(FILES[language], language)
    assert not invalid("\n\n" + FILES[language].replace("\n", "\r\n") + "\n \n", language)


@pytest.mark.parametrize("language", FILES)
def test_conflict_markers(language):
    rows = FILES[language].split("\n")
    assert invalid("\n".join([*rows[:3], "<<<<<<< HEAD", *rows[3:]]), language)


@pytest.mark.parametrize("language", ["javascript", "typescript", "go", "c", "c++", "java", "rust", "json"])
def test_brackets(language):
    text = FILES[language]
    for broken in (text + "}\n", text.replace("}", "", 1), text.rstrip()[:-1], text.replace("(", "((", 1) if "(" in text else text + "]"):
        assert invalid(broken, language)


@pytest.mark.parametrize("language, other", [(a, b) for a in ("javascript", "typescript", "go", "java", "rust", "python", "json", "xml", "sql", "shell") for b in FILES if a != b and (a, b) not in {("typescript", "javascript"), ("shell", "yaml"), ("shell", "ini"), ("javascript", "yaml"), ("javascript", "ini"), ("typescript", "yaml"), ("typescript", "ini"), ("javascript", "json"), ("typescript", "json"), ("python", "json"), ("shell", "sql"), ("python", "ini"), ("python", "yaml"), ("shell", "xml"), ("shell", "json")}])
def test_wrong_language(language, other):
    assert invalid(FILES[other], language)


def test_small_syntax():
    assert invalid(PY.replace("    if a", "     if a"), "python")
    assert invalid('a: "x" rest\n', "yaml") and invalid("[s]\nno value here\n", "ini") and invalid("<a><b></a>", "xml")
    assert invalid(SH.replace("  fi\n", ""), "shell") and invalid(SQL.replace(";\n\nINSERT", "\n\nINSERT").replace("VARCHAR(30)", "VARCHAR(30"), "sql")
    assert not invalid('#define MARK "<<<<<<< x"\nint a;\n', "c") and not invalid("// smile ;-) and {\n" + JS, "javascript")


@pytest.mark.parametrize(
    "language, text",
    [
        ("python", "x = a b\n"), ("python", "f(1, , 2)\n"), ("python", "x = (3 +)\n"), ("python", "return 3 'a'\n"), ("json", '{"a": 1 "b": 2}'), ("json", '{"a": 1,}'), ("json", "{} {}"), ("xml", "text <a/>"), ("xml", "<a>x < y</a>"), ("ini", "a = 1\n[s]\n"), ("ini", "[s]\n  a\n"),
        ("yaml", "a: 1\n<<<<<<< HEAD\nb: 2\n"), ("sql", "SELECT a, FROM t"), ("sql", "SELECT f(, 3) FROM t"), ("sql", "SELECT a FROM t WHERE;"), ("shell", "a && && b\n"), ("shell", "; b\n"), ("shell", "echo 'open\n"), ("java", "int x = = 3;"), ("go", "x := := 3"),
    ],
)
def test_impossible_pairs(language, text):
    kinds = p4.lexers.lex(text, language) if language in p4.lexers.LANGUAGES else p4.grammar.lex(text, language)
    assert any(p not in p4.permitted(language) for p in p4.distinct(kinds))


@pytest.mark.parametrize(
    "text",
    [
        "def f(a, /, *, b: int = 3, **k) -> str:\n    match = a[1:, ::2]\n    return f'{a}' 'b' if a else lambda *x: -x\n", "from . import a\nfrom .. import (b,\n  c)\n@d.e(1)\nasync def g():\n    async with a as b, c: yield\n    x: int = 3; y = [*a, *b]\n    print(x, ...)\n    del x[0].real\n",
        "match x:\n    case {'a': 1, **r} | [1, *_]:\n        pass\n    case _: raise\n", "x = a if b else 3; y = not c; z = a @ b\nwhile (n := f()) > 1e-3: continue\nassert x, 'm'\nx = yield\n", "a = 1 if x else(2)\nb = {**c, 'd': [i for i in e if i]}\nglobal q, r\ntry: pass\nexcept* A as b: ...\n",
    ],
)
def test_possible_python(text):
    assert p4.python_ok(text.replace("global q, r\n", "")) and all(p in p4.permitted("python") for p in p4.distinct(p4.lexers.lex(text, "python")))


def test_invalid_rows(spark):
    rows = [(1, "Python", PY, f"<update_file>{PY}"), (2, "py", PY + "  x = (\n", None), (3, None, "}", "}"), (4, "json", "", "ERROR"), (5, "markdown", "(", "("), (6, "cpp", CPP, "Done <update_file>" + CPP[:-4] + "</update_file>"), (6, "cpp", CPP, "Done <update_file>" + CPP[:-4] + "</update_file>"), (7, "klingon", "(", "(")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "sample_id long, language string, ground_truth string, prediction_raw string, pairs int")
    assert sorted(map(tuple, p4.invalid(p4.lexed(df)).collect())) == [(2, "ground_truth"), (6, "prediction_raw")]
    assert p4.invalid(p4.lexed(df.limit(0))).count() == 0


@pytest.mark.parametrize(
    "text, language, says",
    [
        ("// Code generated by x. DO NOT EDIT.\nint a;\n", "c", "generated"), ("int a;\n# made\n// changes will be lost: autogenerated file\n", "c", "generated"), ('#define B "AUTOGENERATED FILE"\n', "c", None), ("# it is not generated, maintained by hand\n", "python", None),
        ("# Vendored from x 1.2\n", "python", "vendored"), ("# checks that vendored copies match\n", "python", None), ("x=1;" * 300 + "\n", "javascript", "minified"), (JS + '"' + "a" * 700 + '"\n', "javascript", None), ("a = [\n" + "  1, 2, 3,\n" * 40 + "]\n", "python", "data"), ("[\n" + "  1, 2, 3,\n" * 40 + "]\n", "json", None),
        ("", "python", None), (None, None, None), ('{\n "$notice": "Do not modify by hand; regenerate with x"\n}', "json", "generated"),
    ],
)
def test_text_evidence(text, language, says):
    assert p1.text_evidence(text, language) == says


def test_data_on_long_lines():
    rng = random.Random(3)
    numbers, strings = ", ".join(f"0x{rng.randrange(256):02x}" for _ in range(900)), ", ".join(f'"w {i}"' for i in range(900))
    blob = "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=3000))
    wrapped = "\n".join(blob[i : i + 76] for i in range(0, 3000, 76))
    tables = [f"T = [\n{numbers}\n]\n", f"T = [{numbers}]\n", f"const t = [{strings}];\n", "int a;\n" * 12 + f"  {numbers},\n", f'B = "{blob}"\n', f'B = """\n{wrapped}\n"""\n', f'x = "data:image/png;base64,{blob}"\n']
    assert [p1.text_evidence(t, "python") for t in tables] == ["data"] * len(tables)
    assert [p1.text_evidence(t, "python") for t in (PY * 30 + f"T = [{numbers[:300]}]\n", 'print("' + "some words " * 400 + '")\n', "f(1, 2, 3)\n" * 11)] == [None] * 3
    for hard in ("\\\"" * 100_000, "1," * 300_000 + "x", "'" * 100_001, "1 " * 300_000 + "(" * 100_000 + "x", '"' + "a" * 400_000):
        p1.literal_data(hard, hard.split("\n"))  # linear: seconds at most


@pytest.mark.parametrize("path, hit", [("a/vendor/x.py", True), ("a/vendors/x.py", False), ("x/a_pb2.py", True), ("a_min.c", False), ("a.min.js", True), ("third_party_auth/x.c", False), ("b/package-lock.json", True), (None, False), ("", False), ("moc_x.cpp", True), ("src/generator/x.go", False)])
def test_conventions(path, hit):
    assert len(p1.parse_attributes(p1.DEFAULT_RULES)) == len(p1.DEFAULT_RULES.split("\n"))
    assert p1.by_convention(path) == hit


def test_text_of_any_size():
    notice = "// This file was automatically generated from the schema by a tool" + ", and again" * 60
    assert len(notice) > 500 and p1.text_evidence(notice + "\nint a;\n", "c") == "generated"
    assert p1.text_evidence("/* small */ f('do not edit')" + ";g(1)" * 3 + "\n", "c") is None  # code behind a comment
    assert p1.text_evidence("x=1;y(x);" * 36, "javascript") == "minified"  # 324 characters
    literals = "T = [\n" + ", ".join(f"0x{i:04x}" for i in range(320)) + ",\n]\n"
    assert max(map(len, literals.split("\n"))) > 2500 and p1.text_evidence(literals, "python") == "data"


def test_declared_repositories(spark):
    # patterns and conventions stay out of repositories with a file of their own; the deepest directory wins
    rows = [(1, "o/r", ".gitattributes", "*.c linguist-generated\nlib/** -linguist-vendored\n"), (2, "o/r", "lib/.gitattributes", "keep.c linguist-vendored\n"), (3, "o/r", "vendor/x.py", "y"), (4, "o/r", "a.c", "y"), (5, "o/r", "lib/a.c", "// @generated\n"), (6, "o/r", "lib/keep.c", "y"), (7, "o/s", "vendor/x.py", "y"), (8, None, "vendor/x.py", "y"), (9, "o/r", None, "// @generated\n"), (10, "o/r", "b.h", None)]
    rows += [(100 + i, "o/r", f"d{i}/f.c", "y") for i in range(3000)]  # a hot repository
    df = spark.createDataFrame([(i, r, p, "c", t) for i, r, p, t in rows], "sample_id long, repo string, path string, language string, original_code string")
    got = {r.id: r.reason for r in p1.not_by_hand(df).collect()}
    assert {k: v for k, v in got.items() if k < 100} == {4: "declared", 6: "declared", 7: "convention", 8: "convention", 9: "generated"} and len(got) == 3005


def test_attributes():
    rules = p1.parse_attributes("# note\n*.gen.go linguist-generated\nlib/** linguist-vendored=true\nlib/own/** -linguist-vendored\nx.c text\n/a/[bc]?.js linguist-generated=false")
    assert [(n, m) for n, _, m in rules] == [(1, True), (2, True), (3, False), (5, False)]
    match = [re.compile(r) for _, r, _ in rules]
    assert match[0].match("a/b.gen.go") and match[0].match("b.gen.go") and not match[0].match("b.go")
    assert match[1].match("lib/x/y.c") and not match[1].match("a/lib/x.c") and match[3].match("a/bx.js") and not match[3].match("a/dx.js")


def test_not_by_hand(spark):
    rows = [(1, "o/r", ".gitattributes", None, "*.gen linguist-generated\n"), (2, "o/r", "x/a.gen", "c", "int a;"), (3, "O/R", "x/own/b.gen", "c", "int b;"), (4, "o/r", "x/own/.gitattributes", None, "b.gen -linguist-generated"), (5, None, None, "c", "// @generated\n"), (6, "z/z", "a/vendor/b.c", "c", None), (7, "z/z", "a/b.c", "c", "int c;")]
    rows += [(100 + i, f"m/{i % 5}", f"lib/odd/f{i}.c", "c", "// Copied verbatim from x\n" if i < 6 else "int d;") for i in range(10)]
    rows += [(200 + i, "m/0", f"lib/f{i}.c", "c", "int e;") for i in range(60)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "sample_id long, repo string, path string, language string, original_code string, reason string")
    got = {r.id: r.reason for r in p1.not_by_hand(df).collect()}
    assert got[2] == "declared" and 3 not in got and got[5] == "generated" and got[6] == "convention" and 7 not in got
    assert all(got[100 + i] == "mined" for i in range(10)) and not any(200 + i in got for i in range(60))
    assert p1.not_by_hand(df.limit(0)).count() == 0


def test_defects():
    d = lambda answer, **k: (p2.defects(p2.content(answer), k.get("snippet", "// ... existing code ..."), k.get("original", JS), k.get("language", "javascript"), False) or [None])[0]
    assert d(None) == d(" ") == d("<update_file> ERROR </update_file>") == d("<update_file></update_file>") == "empty"
    assert d(f"<update_file>{JS}") == "copy" and d("\n" + JS + " ") == "copy" and d("x", snippet="x") == "copy"
    assert d("<update_file># I'm sorry, but I cannot apply this edit.</update_file>") == "refusal" and d("Es tut mir leid, das kann ich nicht tun.") == "refusal"
    assert d(JS + 'const SORRY = "I\'m sorry, I cannot open this";\n') is None
    long = "".join(JS.replace("function f", f"function f{i}").replace("x > 2", f"x > {i}00") for i in range(6))
    assert d(long[: len(long) // 2], original=long) == "truncated" and d(long[: int(len(long) * 0.85)], original=long) == "truncated"
    assert d(long.replace("x > 300", "x > 301"), original=long) is None and d(long[: int(len(long) * 0.97)], original=long) is None
    assert d("import os\nfrom a import b\n\n\ndef g(x):\n    if x:\n        return 1\n") == "other_language" and d("Das Modul liest das Ergebnis nach jedem Lauf und die Funktion prüft den Rest der Datei.") == "other_language"
    assert d(long.replace("}", ")", 1), original=long) is None
    assert p2.defects("a", " ", "b", "c", True) == ["empty"]


def test_all_defects():
    d = lambda answer, snippet="x", original=JS * 4: p2.defects(answer, snippet, original, "javascript", False)
    assert d(JS.split("}")[0], JS.split("}")[0]) == ["copy", "truncated"]
    assert d("// Sorry, I can't help with that file.") == ["refusal", "truncated"]
    assert d(PY + "def g(") == ["other_language", "truncated"]
    assert d("return f(a,\n", "return f(a,", None) == ["copy", "truncated"]  # without an original the open end tells
    assert d(JS * 4) == ["copy"] and d(PY.replace("\n", "\n\n") * 9, original=None)[-1] == "other_language"


def test_defects_of_any_size():
    d = lambda answer, original=JS * 4, snippet="x", language="javascript": p2.defects(answer, snippet, original, language, False)
    plea = "I'm sorry, but I cannot apply this change.\n" + "The file is too large for me and the edit is not clear enough.\n" * 8
    assert d(plea)[0] == "refusal" and d(plea + "Please send it in parts and say where each of them belongs.\n" * 30)[0] == "refusal"
    notes = "Unfortunately the old parser is slow.\n" + "".join(f"It reads line {i} of the log and keeps it for later use.\n" for i in range(30))
    assert d(notes, notes + "More of it is to come.\n", language="markdown") == []  # a file that uses such words
    wide = "".join(f"var a{i}=f({i},b{i});" for i in range(900))  # some 20 KB on one line
    assert len(wide) > 18_000 and d(wide[: len(wide) // 2], wide) == ["truncated"] and d(wide[: int(0.8 * len(wide))], wide) == ["truncated"]
    assert d(wide.replace("f(450,", "g(451,"), wide) == [] and d(wide[: len(wide) // 2] + "var new1=1;" + wide[len(wide) // 2 :], wide) == []
    assert d("SELECT a FROM t WHERE b > 3;\n", None, language="python") == ["other_language"] and d("Update the file as described.\n", None, language="python") == []


def test_pairs_table(spark):
    rows = [("1", None, "s", JS, "js", None), ("2", JS + "// more\n", None, None, None, None), ("2", JS + "// more\n", None, None, None, None), ("3", JS[:60], None, None, "js", JS), ("4", JS, None, " ", "js", JS)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "record_id string, answer string, snippet string, original string, language string, whole string, defects int")
    assert sorted(tuple(r) for r in p2.judge(df, False).collect()) == [("1", ["empty"]), ("3", ["truncated"])]
    assert p2.judge(df.limit(0), True).count() == 0


def secret(rng, n=24):
    return "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)) + "7aZ"


@pytest.fixture(scope="module")
def credentials():
    rng = random.Random(3)
    good, bad = [], []
    for i in range(60):
        s = secret(rng)
        good += [f'DB_PASSWORD = "{s}"', f"export API_KEY='{s}'", f'url = "postgres://u:{s}@h.test/db"', f'h = "Bearer {s}"', f"# root pw for staging -> {s}", f'x = "ghp_{s}{s}"'][i % 6 : i % 6 + 1]
        bad += ['DB_PASSWORD = "${DB_PASSWORD}"', f'BUILD_DIGEST = "{rng.randrange(16**32):032x}"', 'PASSWORD_LABEL = "Please enter a password"', "token_a = load_token(3)", f'uuid = "1b2c3d4e-1111-2222-3333-{rng.randrange(10**12):012d}"', 'API_KEY = "your-token-here"', "pulley_token: report-2490"][i % 7 : i % 7 + 1]
    return good, bad


def test_credentials(spark, credentials):
    good, bad = credentials
    rows = [(i, "a/b.py", f"import os\n{x}\n", None) for i, x in enumerate(good)] + [(1000 + i, "a/b.py", f"import os\n{x}\n", "") for i, x in enumerate(bad)]
    rows += [(2000, None, 'k = """-----BEGIN RSA PRIVATE KEY-----\nAbc123\nxyz9\n-----END RSA PRIVATE KEY-----"""\n', None), (2001, None, "-----BEGIN PUBLIC KEY-----\nAbc\n-----END PUBLIC KEY-----", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "sample_id long, path string, original_code string, ground_truth string, field string")
    detector = p7.train(df)
    got = {(r.sample_id, r.line_no) for r in p7.find(df, detector).collect()}
    assert got == {(i, 2) for i in range(len(good))} | {(2000, 1)}
    clean = {r.sample_id: r for r in p7.blot(df, detector).collect()}
    for i, x in enumerate(good):
        text = clean[i].original_code
        assert len(text) == len(rows[i][2]) and text.split("\n")[0] == "import os" and "7aZ" not in text
    assert all(clean[1000 + i].original_code == rows[len(good) + i][2] for i in range(len(bad)))
    assert clean[2000].original_code == 'k = """-----BEGIN RSA PRIVATE KEY-----\nxxxxxx\nxxxx\n-----END RSA PRIVATE KEY-----"""\n'
    assert p7.find(df.limit(0), p7.train(df.limit(0))).count() == 0


def test_places_of_credentials():
    mine = p7.Detector(p7.Markov({}), None)
    key = "-----BEGIN PRIVATE KEY-----\nAb1\n\nxyz\n-----END PRIVATE KEY-----"
    text = f"a\n\nPASSWORD = 'Zq8#kk3Lm2'\nx = 1\n{key} # tail\nb\nAPI_KEY = 'q9Wz8xR7tT'\n\n-----BEGIN RSA PRIVATE KEY-----\nrest 1\nTOKEN='q9Wz8xR7tT'"
    found = mine.find([text, None, "", "API_KEY = 'q9Wz8xR7tT'", f"{key}\n{key}"], ["a.py"] * 5)
    assert [n for n, *_ in found[0]] == [3, 5, 11, 13] and found[1] == found[2] == [] and found[3] == [(1, 11, 21)] and [n for n, *_ in found[4]] == [1, 6]
    assert text[found[0][0][1] : found[0][0][2]] == "Zq8#kk3Lm2" and text[found[0][1][1] : found[0][1][2]] == "\nAb1\n\nxyz\n" and found[0][3][2] == len(text)


def test_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = np.where(x[:, 1] > 0.3, 3.0, 1.0) + 0.05 * rng.normal(size=600)
    model = trees.Boosted(rounds=60).fit(x[:400], y[:400])
    assert np.abs(model.predict(x[400:]) - y[400:]).mean() < 0.2
    a, b = trees.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert (np.diff(b) >= 0).all() and np.interp(2.5, a, b) == pytest.approx(2.5)
    assert trees.Boosted().fit(np.empty((0, 2)), np.empty(0)).predict(x[:, :2]).tolist() == [0.0] * 600


def test_levels(spark):
    easy, hard = "We run the old job now. You can see the log! " * 5, "Heterogeneous canonicalization necessitates interdependent parameterization " * 6 + "."
    mid = "The server validates the default parser before every release and logs the result of the last run. " * 3
    rows = [(i, t) for i, t in enumerate([easy, mid, hard] * 12)] + [(90, "too short."), (91, None), (92, ""), (93, "word " * 40), (94, "```\nx.\n" + "w " * 40 + "```")]
    measured = p10.features(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, x int")).cache()
    labels = spark.createDataFrame([(i, f"g{i % 3}", 1 + i % 3) for i in range(30)], "doc_id long, grader string, grade int")
    sources = spark.createDataFrame([(i, f"s{i % 7}") for i in range(36)], "id long, source string")
    model = p10.train(measured, labels, sources)
    got = {r.id: (r.level, r.agreed, r.defined) for r in p10.levels(measured, model).collect()}
    assert got == {i: (("easy", "medium", "hard")[i % 3],) * 3 for i in range(36)}
    bare = p10.levels(measured, p10.train(measured, labels.limit(0), sources)).collect()
    assert {r.level for r in bare} == {"easy", "medium", "hard"} and all(r.grade is None for r in bare)
    assert p10.features(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    measured.unpersist()


def test_trees_decide(spark):
    # grades turned round: the trees learn them and, being of one mind, decide; without labels the check does
    texts = ["We run the old job now. You can see the log! " * 5, "The server validates the default parser before every release and logs the result of the last run. " * 3, "Heterogeneous canonicalization necessitates interdependent parameterization " * 6 + "."]
    measured = p10.features(spark.createDataFrame(list(enumerate(texts * 12)), "doc_id long, text string")).cache()
    labels = spark.createDataFrame([(i, "g", 3 - i % 3) for i in range(30)], "doc_id long, grader string, grade int")
    sources = spark.createDataFrame([(i, f"s{i % 7}") for i in range(36)], "id long, source string")
    got = sorted(map(tuple, p10.decided(p10.levels(measured, p10.train(measured, labels, sources))).collect()))
    assert got == [("easy", "trees", False, 12), ("hard", "trees", False, 12), ("medium", "trees", True, 12)]
    bare = p10.decided(p10.levels(measured, p10.train(measured, labels.limit(0), sources))).collect()
    assert sorted(map(tuple, bare)) == [("easy", "check", True, 12), ("hard", "check", True, 12), ("medium", "check", True, 12)]
    measured.unpersist()


def test_held_out_calibration():
    # the knots that score a fold are made without it: a fold of its own kind is not fitted away
    rows = pd.DataFrame({"x": [[float(i % 3)] * len(p10.FEATURES) for i in range(60)], "y": [1.0 + i % 3 for i in range(60)], "weight": 1.0, "fold": [i % 5 for i in range(60)]})
    rows.loc[rows.fold == 0, "y"] = 4.0 - rows.y
    folds = p10.Model(rows).folds
    wrong = folds[folds.fold == 0]
    assert (wrong.calibrated - wrong.y).abs().mean() > 1.0


def test_values_of_all_rows(spark):
    # the least hash is one row's only; the model of ordinary values knows both fields of the others too
    df = spark.createDataFrame([(i, "a.py", f'name = "{v}"\n', f'other = "{w}"\n') for i, (v, w) in enumerate([("zqzqzqzq", "jxjxjxjx"), ("vkvkvkvk", "wbwbwbwb"), ("ydydydyd", "hghghghg")])], "sample_id long, path string, original_code string, ground_truth string")
    bits = p7.train(df, sample=1).markov.bits
    assert {("z", "q"), ("j", "x"), ("v", "k"), ("w", "b"), ("y", "d"), ("h", "g")} <= set(bits)


def test_names():
    assert language_of(" CPlusPlus ") == "c++" and language_of("") is None and language_of(None) is None and language_of("Cobol") == "cobol"

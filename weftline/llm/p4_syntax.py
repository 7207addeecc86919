"""Problem 4: source files that do not parse.

Each file of every language is lexed into token classes (:mod:`grammar`,
:mod:`lexers`). Its distinct pairs of neighbouring tokens become DataFrame rows,
and an anti-join against the pairs that the language's grammar permits leaves
the impossible ones. Nesting and statements are then checked in windows: bracket
groups are reduced from the inside out, each window by its production; shell and
SQL have productions of their own, and for Python, YAML, XML and JSON the
parsers of the standard library (and of PyYAML, where it is installed) make an
exact check of what pairs can't tell. Windows are reduced within the row of
their file: as rows of their own, tokens would have to be shuffled and sorted by
file first, which is several times the input.

Defined results: null and blank languages, empty contents (null, blank,
``ERROR``), markdown and unknown languages are no cases; blank lines at both
ends don't count; very long files are read whole; repeated rows are judged
alike; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, stored, table
from . import grammar, lexers
from .languages import SPELLINGS, language_of
from .p2_pairs import content, is_empty
from .p3_splits import repo_name

try:
    import yaml
except ImportError:
    yaml = None

FIELDS = ("prediction_raw", "ground_truth")


def python_ok(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def json_ok(text: str) -> bool:
    try:
        json.loads(text.lstrip("\ufeff"))
        return True
    except (ValueError, RecursionError):
        return False


def xml_ok(text: str) -> bool:
    parser = expat.ParserCreate()
    try:
        parser.Parse(text.strip().encode("utf-8", "replace") if "encoding=" not in text[:100].lower() or "utf-8" in text[:100].lower() else text.strip(), True)
        return True
    except expat.ExpatError:
        return False


def yaml_ok(text: str) -> bool:
    text = text.replace("\r\n", "\n")
    if yaml is not None:
        loader = getattr(yaml, "CParser", None)
        try:
            keys: list[set] = []
            for event in yaml.parse(text, Loader=getattr(yaml, "CLoader", yaml.SafeLoader)) if loader else yaml.parse(text):
                del event
            del keys
        except (yaml.YAMLError, ValueError, RecursionError):
            return False
        # a file of nothing but one bare scalar over several lines is prose or code
        body = [x for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#")]
        return not body or len(body) < 3 or any(re.match(r"\s*(?:- |[^\s:#][^:#]*:(?:\s|$)|[\[{\"'?]|---)", x) for x in body)
    for line in text.split("\n"):
        if line.strip() and not re.match(r"\s*(?:#|---|\.\.\.|- |-$|[\w\"'$./<>*&!?-][^:]*:(?:\s|$)|[\]}\"'\w\[{|>])", line) or re.match(r" *\t", line):
            return False
    return True


def shell_ok(text: str) -> bool:
    """Quotes, brackets and the words that open and close commands must match."""
    stack: list[str] = []
    start, words, previous, pattern = True, 0, "", False
    for m in lexers.SHELL.finditer(text):
        t = m.group()
        if t.isspace() and "\n" not in t or t[0] == "#" and len(t) > 1 and previous != "word":
            previous = "" if t.isspace() else previous
            continue
        if t in ("'", '"', "`") and t != "`":
            return False
        if re.match(r"(?:<{7}|>{7}|={7})", t) and start:
            return False
        if t in ("\n", ";", "&", "|", "&&", "||") or t.isspace():
            if t in (";", "&&", "||", "|") and start and previous in ("sep",) and not pattern:
                return False
            start, words, previous = True, 0, "sep" if t != "\n" and not t.isspace() else ""
            continue
        if t == ";;":
            pattern, start, words, previous = True, True, 0, ""
        elif t in ("$(", "$(("):
            stack.append("(" if t == "$(" else "((")
            start, words, previous = True, 0, ""
        elif t == "(":
            if previous == "word" and words == 1 and re.match(r"\s*\)", text[m.end() : m.end() + 3]) or previous == "=" or start or stack and stack[-1].startswith("("):
                stack.append("(")
                start = previous != "="
            else:
                return False
        elif t == ")":
            if stack and stack[-1] == "(":
                stack.pop()
                start, previous = False, "word"
                if re.match(r"\s*\{", text[m.end() : m.end() + 4]):
                    start = True
            elif stack and stack[-1] == "((":
                stack[-1] = "("
            elif stack and stack[-1] == "case" and pattern:
                pattern, start, words, previous = False, True, 0, ""
            else:
                return False
        elif t == "{":
            if start:
                stack.append("{")
            previous = "word"
        elif t == "}":
            if start:
                if not stack or stack.pop() != "{":
                    return False
                start = False
            previous = "word"
        else:
            if start and not pattern:
                if t in ("if", "case", "for", "while", "until", "select"):
                    stack.append(t)
                    start = t in ("if", "while", "until")
                    previous, words = "word", 1
                    continue
                if t == "then":
                    if not stack or stack[-1] not in ("if", "elif"):
                        return False
                    stack[-1] = "then"
                    start = True
                    continue
                if t in ("else", "elif"):
                    if not stack or stack[-1] != "then":
                        return False
                    stack[-1] = "elif" if t == "elif" else "else"
                    start = True
                    continue
                if t == "fi":
                    if not stack or stack.pop() not in ("then", "else"):
                        return False
                elif t == "do":
                    if not stack or stack[-1] not in ("for", "while", "until", "select"):
                        return False
                    stack[-1] = "do"
                    start = True
                    continue
                elif t == "done":
                    if not stack or stack.pop() != "do":
                        return False
                elif t == "!":
                    continue
            if t == "in" and stack and stack[-1] == "case" and not pattern:
                pattern, start, previous = True, True, ""
                continue
            if t == "esac":
                if not stack or stack.pop() != "case":
                    return False
                pattern = False
            words += 1 if previous != "word" else 0
            previous = "=" if t.endswith("=") and words == 1 else "word"
            start = bool(start and re.fullmatch(r"\w+=.*", t) and False)
    return not stack


_SQL = re.compile(r"--[^\n]*|/\*(?:.|\n)*?\*/|'(?:''|[^'])*'|\"(?:\"\"|[^\"])*\"|`[^`]*`|\$(\w*)\$(?:.|\n)*?\$\1\$")
_SQL_VERBS = re.compile(
    r"(?i)\s*(?:select|insert\s+(?:into|or|ignore|overwrite)|update\s+\S+|delete\s+from|create\s+(?:or\s+replace\s+)?(?:global\s+|local\s+)?(?:temp(?:orary)?\s+|unique\s+|unlogged\s+|materialized\s+|external\s+)*(?:table|index|view|schema|database|sequence|function|procedure|trigger|type|user|role|extension|domain)|alter\s+\w+|drop\s+\w+|with\s+\w+|begin|commit|rollback|start\s+transaction|grant\s+|revoke\s+|set\s+|explain\s+|merge\s+into|truncate\s+|use\s+\w+|declare\s+|call\s+|execute\s+|analyze|vacuum|comment\s+on|copy\s+|lock\s+|replace\s+into|values\s*\(|pragma\s+|end|if\s+|return|show\s+|do\s+|savepoint\s+|\()"
)
_SQL_BAD = re.compile(r"(?i)\(\s*,|,\s*,|,\s*\)|[=<>+]\s*(?:\)|$)|\b(?:where|from|set|and|or|join|on|by|values|into|select|table)\s*(?:\)|$)|,\s*(?:from|where|$)|[{}\[\]#@\\]|\(\s*\)\s*\(|\b\w+\s*=\s*\w+\s*=|:=|==|&&|!(?!=)")


def sql_ok(text: str) -> bool:
    bare = _SQL.sub(lambda m: " " if m.group()[:2] in ("--", "/*") else " 'x' ", text)
    if re.search(r"[\"`]", bare) or bare.count("'") % 2 or grammar._CONFLICT.search(bare):
        return False
    depth = 0
    for c in re.findall(r"[()]", bare):
        depth += 1 if c == "(" else -1
        if depth < 0:
            return False
    if depth:
        return False
    parts = [s.strip() for s in bare.split(";")]
    for s in parts:
        if not s:
            continue
        if not _SQL_VERBS.match(s) or _SQL_BAD.search(s):
            return False
        head = s.split(None, 1)[0].lower()
        if head == "update" and not re.search(r"(?i)\bset\s+\S", s) or head == "insert" and not re.search(r"(?i)\b(?:values\s*\(|select\b|default\s+values|set\s)", s):
            return False
        if head == "create" and re.match(r"(?i)create\s+(?:\w+\s+)*table\b", s) and not re.search(r"(?i)\(|\bas\b|\blike\b", s):
            return False
        if head == "alter" and len(s.split()) < 4 or head in ("drop", "delete") and len(s.split()) < 3:
            return False
    return True


_OWN = {"python": python_ok, "json": json_ok, "xml": xml_ok, "yaml": yaml_ok, "shell": shell_ok, "sql": sql_ok}


def trimmed(text: str) -> str:
    """Without blank lines at both ends."""
    return re.sub(r"\A(?:[ \t\r\f\v]*\n)+|(?:\n[ \t\r\f\v]*)+\Z", "", text.replace("\r\n", "\n"))


def check(text: str, language: str) -> tuple[bool, list[str]]:
    """Whether lexing, nesting and statements fail, and the distinct pairs of neighbours."""
    text = trimmed(text)
    if language in lexers.LANGUAGES:
        exact = _OWN.get(language)
        return exact is not None and not exact(text), distinct(lexers.lex(text, language))
    if grammar.foreign(text, language):
        return True, []
    kinds = grammar.lex(text, language)
    if kinds is None:
        return True, []
    return not grammar.reduces(kinds, language), distinct(kinds)


def distinct(kinds: str) -> list[str]:
    """The distinct pairs of neighbours."""
    return sorted({a + b for a, b in zip(kinds, kinds[1:])})


def permitted(language: str) -> frozenset[str]:
    """The pairs of neighbours that the grammar of a language permits."""
    return (lexers if language in lexers.LANGUAGES else grammar).neighbours(language)


def lexed(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """``id``, ``field``, ``language``, ``broken`` and ``pairs`` of each file that can be a case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, name, *texts in zip(*(c.to_pylist() for c in batch.columns)):
                language = language_of(name)
                if language not in SPELLINGS or language == "markdown":
                    continue
                for field, text in zip(FIELDS, texts):
                    body = content(text) if field == "prediction_raw" else text
                    if not is_empty(body):
                        out.append((i, field, language, *check(body, language)))
            c = list(zip(*out)) if out else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(c, kinds)], ["id", "field", "language", "broken", "pairs"])

    picked = df.select(F.col(key).cast("long").alias("id"), "language", *FIELDS)
    return picked.mapInArrow(run, "id long, field string, language string, broken boolean, pairs array<string>")


def permissible(spark: SparkSession) -> DataFrame:
    """``language`` and ``pair``: a table bounded by the grammars."""
    return spark.createDataFrame([(g, p) for g in sorted(grammar.BRACKETED | lexers.LANGUAGES) for p in sorted(permitted(g))], "language string, pair string")


def invalid(files: DataFrame) -> DataFrame:
    """``id`` and ``field`` of files with an impossible pair of neighbours or a broken structure."""
    # a file is one row until here, so nothing is shuffled: the pairs table is broadcast
    rows = files.select("id", "field", "language", F.explode(F.when(F.col("broken"), F.array(F.lit(""))).otherwise(F.col("pairs"))).alias("pair"))
    return rows.join(F.broadcast(permissible(files.sparkSession)), ["language", "pair"], "left_anti").select("id", "field").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(table(spark, sf_dir, "apply_samples").select("sample_id", "language", *FIELDS))
    return invalid(lexed(df)).select(F.col("id").alias("sample_id"), "field")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: files, those with an impossible pair of neighbours, and those that fail in the windows or the exact check."""
    files = stored(lexed(spread(table(spark, sf_dir, "apply_samples").select("sample_id", "language", *FIELDS))), "lexed")
    paired = invalid(files.withColumn("broken", F.lit(False))).withColumn("paired", F.lit(1))
    out = files.select("id", "field", "language", "broken").join(paired, ["id", "field"], "left").groupBy("language")
    return out.agg(F.count(F.lit(1)).alias("files"), F.count("paired").alias("by_pairs"), F.count(F.when(F.col("broken"), 1)).alias("by_windows"))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, invalid files and their share per repository and language."""
    rows = table(spark, sf_dir, "apply_samples")
    files = stored(lexed(spread(rows.select("sample_id", "language", *FIELDS))), "lexed")
    bad = invalid(files).withColumn("bad", F.lit(1))
    repos = rows.select(F.col("sample_id").alias("id"), repo_name(F.col("repo")).alias("repo"))
    every = files.select("id", "field", "language").join(repos, "id").join(bad, ["id", "field"], "left")
    out = every.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), F.count("bad").alias("invalid"))
    return out.withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))


QUERIES = {"p4_found": (p4_found, None), "p4_pairs": (p4_pairs, None), "p4_rates": (p4_rates, None)}

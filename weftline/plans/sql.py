"""Fragments of the SQL that the queries are checked with."""

from __future__ import annotations

from ..functions.text import ALIASES, EXTENSIONS, MARKERS

SPACE = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def lang(c: str) -> str:
    return f"(CASE lower(trim({c})) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items()) + f" ELSE lower(trim({c})) END)"


def report_lang(c: str) -> str:
    return f"coalesce(nullif({lang(c)}, ''), 'unknown')"


def ext(c: str) -> str:
    return f"(CASE {lang(c)} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EXTENSIONS.items()) + f" ELSE {lang(c)} END)"


def nl(c: str) -> str:
    return f"regexp_replace({c}, '\\r\\n?', chr(10), 'g')"


def strip(c: str) -> str:
    return f"trim({c}, {SPACE})"


def body(c: str) -> str:
    return f"(CASE WHEN contains({c}, '<update_file>') THEN substr({c}, instr({c}, '<update_file>') + 13) ELSE {c} END)"


def unwrapped(c: str) -> str:
    return f"(CASE WHEN contains({body(c)}, '</update_file>') THEN regexp_extract({body(c)}, '(?s)\\A(.*)</update_file>', 1) ELSE {body(c)} END)"


def cleaned(c: str) -> str:
    out = f"coalesce({c}, '')"
    for m in MARKERS:
        lit = "'" + m.replace("\n", "' || chr(10) || '") + "'"
        out = f"replace({out}, {lit}, '')"
    return f"replace({out}, chr(160), ' ')"


def text_form(c: str) -> str:
    return f"regexp_replace(regexp_replace({nl(c)} || chr(10), '[ \\t\\f\\v]+\\n', chr(10), 'g'), '\\n+\\z', '')"


def markdown_form(c: str) -> str:
    return f"trim(regexp_replace({text_form(c)}, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10))"


def sql_form(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"


def lines(c: str) -> str:
    return f"string_split({c}, chr(10))"


def times(c: str, what: str) -> str:
    return f"CAST((length({c}) - length(replace({c}, '{what}', ''))) / {len(what)} AS INTEGER)"


def blank(c: str) -> str:
    return f"({c} IS NULL OR {strip(c)} = '')"


def order_key(c: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || CAST({c} AS VARCHAR))"

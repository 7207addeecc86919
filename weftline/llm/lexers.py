"""Token classes and permissible neighbours of the languages that aren't bracketed throughout.

Like :mod:`grammar`, a text becomes one character per token, and the pairs of
neighbours follow from what each class may begin, end or stand between. ``^``
and ``$`` are the two ends of a text, ``x`` is what is no token at all and has no
neighbour. Python, JSON, SQL and shell are lexed into words and signs, XML into
tags, INI and YAML into lines. What pairs can't tell, such as nesting, is left
to the productions and parsers that follow.
"""

from __future__ import annotations

import re
from functools import cache

#: Reserved words of Python by role; the soft ones may also be names.
_PYTHON = {
    **dict.fromkeys("and as assert async await class def del elif except finally for from global if import in is lambda nonlocal not or raise return try while with yield else".split(), "K"),
    **dict.fromkeys("pass break continue".split(), "F"),
    **dict.fromkeys("match case type print exec".split(), "m"),
}
_PY_TEXT = re.compile(r"""(?P<c>#[^\n]*|\\\r?\n)|(?:\b[rRbBuUfFtT]{1,2})?(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')""", re.S)
_PY_NUMBER = re.compile(r"(?<![\w.])(?:0[xX][\da-fA-F_]+|0[bBoO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?)|(?<=\W)\.\d[\d_]*(?:[eE][+-]?\d+)?")
_NAME = re.compile(r"[^\W\d]\w*")
_PY_SIGN = re.compile(r"\.\.\.|->|:=|(?:\*\*|//|>>|<<|[-+*/%@&|^])=(?!=)|==|!=|<=|>=|\*\*|//|<<|>>|[-+~*/%@&|^<>=]")
_PY_SIGNS = {"...": "i", "->": "o", ":=": "o", "~": "~", "-": "-", "+": "-", "*": "*", "**": "*", "/": "/", "@": "@", "=": "="}
_BLANK = {ord(c): None for c in " \t\r\f\v﻿"}
_JSON = re.compile(r'"(?:\\.|[^"\\\n])*"|-?\d[\d.eE+-]*|\w+|\s+|.', re.S)
_XML = re.compile(r"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>|<!DOCTYPE(?:[^<>\[]|\[.*?\])*>|</[^<>]*>|<(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<", re.S)
_SQL_TEXT = re.compile(r"(?P<c>--[^\n]*|/\*(?:.|\n)*?\*/)|'(?:''|[^'])*'|\"(?:\"\"|[^\"])*\"|`[^`]*`|\$(?P<d>\w*)\$(?:.|\n)*?\$(?P=d)\$")
#: Words of SQL after which something must follow.
_SQL_WORDS = {**dict.fromkeys("where from".split(), "f"), **dict.fromkeys("set and or join on by values into select table".split(), "K")}
_SQL_SIGN = re.compile(r":=|==|&&|!(?!=)|::|<=|>=|<>|!=|\|\||[=<>+]|[-/%|&^~]|[{}\[\]#@\\\"'`]")
#: Quotes, expansions, comments, here-documents, signs and words of shell.
SHELL = re.compile(r"\\.|'[^']*'|\"(?:\\.|\$\((?:[^()\"]|\"[^\"]*\"|\([^()]*\))*\)|\$(?!\()|[^\"\\$])*\"|\$\{[^}]*\}|\$\(\(|\$\(|(?<![\w$\"'])#[^\n]*|<<-?\s*(['\"]?)(\w+)\1[^\n]*\n(?:[^\n]*\n)*?[ \t]*\2(?=\n|\Z)|\$[\w@#?*!$-]|;;|&&|\|\||[;&|\n(){}]|[^\s;&|(){}\\'\"#$]+|#|\s+|.", re.S)
_SHELL_MARK = re.compile(r"(?:<{7}|>{7}|={7})(?:\s|\Z)")


def _python(text: str) -> str:
    bare = _PY_TEXT.sub(lambda m: " " if m.group("c") is not None else ' \x01 ', text)
    bare = _NAME.sub(lambda m: _PYTHON.get(m.group(), "i") + " ", _PY_NUMBER.sub("\x02 ", bare))
    bare = _PY_SIGN.sub(lambda m: _PY_SIGNS.get(m.group(), "=" if m.group()[-1] == "=" and m.group() not in ("==", "!=", "<=", ">=") else "o"), bare)
    bare = re.sub(r"\n+", "n", bare.translate(_BLANK)).replace("\x01", "s").replace("\x02", "0")
    return re.sub(r"[^i0sKFmno\-~*/@=.,:;()\[\]{}]", "x", bare)


def _json(text: str) -> str:
    out = []
    for t in _JSON.findall(text.lstrip("﻿")):
        c = t[0]
        if c == '"':
            out.append("s" if len(t) > 1 else "x")
        elif c in "{}[]:,":
            out.append(c)
        elif t in ("true", "false", "null", "NaN", "Infinity"):
            out.append("k")
        elif c.isdigit() or c == "-":
            out.append("0" if len(t) > 1 or c != "-" else "-")
        elif not c.isspace():
            out.append("x")
    return "".join(out)


def _xml(text: str) -> str:
    out = []
    for t in _XML.findall(text.strip().lstrip("﻿")):
        if t[0] != "<":
            if t.strip():
                out.append("T")
        elif t == "<":
            out.append("x")
        elif t.startswith("<!--"):
            out.append("C")
        elif t.startswith("<?"):
            out.append("P")
        elif t.startswith("<!["):
            out.append("D")
        elif t.startswith("<!"):
            out.append("!")
        else:
            out.append("E" if t[1] == "/" else "M" if t.endswith("/>") else "S" if t[1:2].isalpha() or t[1:2] in ("_", ":") else "x")
    return "".join(out)


def _ini(text: str) -> str:
    out = []
    for line in text.split("\n"):
        bare = line.strip()
        if not bare or bare[0] in "#;":
            continue
        if line[0] in " \t" and out and out[-1] in "k+":
            out.append("+")
        elif re.fullmatch(r"\[[^\[\]\n]+\]\s*(?:[;#].*)?", bare):
            out.append("[")
        else:
            out.append("k" if re.match(r"[^\s=:<>{}][^=:]*?\s*[=:]", bare) and not re.match(r"(?:<{7}|={7}|>{7})", bare) else "x")
    return "".join(out)


def _yaml(text: str) -> str:
    """Lines: key, item, ``d`` document mark, ``S`` a bare word at the left edge, ``s`` anything else."""
    out = []
    for line in text.split("\n"):
        bare = line.strip()
        if not bare or bare[0] == "#":
            continue
        if line.startswith(("---", "...", "%")):
            out.append("d")
        elif re.match(r"<{7} |={7}\s*$|>{7} ", line):
            out.append("x")
        elif bare[0] == "-" and bare[1:2] in ("", " "):
            out.append("-")
        elif re.match(r"[^:#\"'{}\[\]]+:(?:\s|$)", bare):
            out.append("k")
        else:
            out.append("s")
    return "".join(out)


def _sql(text: str) -> str:
    bare = _SQL_TEXT.sub(lambda m: " " if m.group("c") is not None else " \x01 ", text)
    bare = re.sub(r"(?<![\w.])\d[\w.]*", "\x02 ", bare)
    bare = re.sub(r"[^\W\d][\w$]*", lambda m: _SQL_WORDS.get(m.group().lower(), "i") + " ", bare)
    bare = _SQL_SIGN.sub(lambda m: "o" if m.group() in "=<>+" or m.group() in ("<=", ">=", "<>", "!=") else "b" if m.group() in ("::", "||") or m.group() in "-/%|&^~" else "x", bare)
    bare = re.sub(r"\s+", "", bare).replace("\x01", "s").replace("\x02", "0")
    return re.sub(r"[^i0sKfobx*.,;:()?$]", "x", bare)


def _shell(text: str) -> str:
    out = []
    for m in SHELL.finditer(text):
        t = m.group()
        if t == "\n" or t.isspace() and "\n" in t:
            out.append("n")
        elif t.isspace() or t[0] == "#" and (len(t) > 1 or not out):
            out.append(" ")
        elif t in ("&&", "||", "|"):
            out.append("A")
        elif t == ";;":
            out.append("D")
        elif t in ("$(", "$(("):
            out.append("$")
        else:
            out.append(t if t in ";&(){}" else "x" if t in ("'", '"') or out[-1:] in ([], ["n"]) and _SHELL_MARK.match(t + " ") else "w")
    return "".join(out).replace(" ", "")


_LEX = {"python": _python, "json": _json, "xml": _xml, "ini": _ini, "yaml": _yaml, "sql": _sql, "shell": _shell}
LANGUAGES = frozenset(_LEX)


def lex(text: str, language: str) -> str:
    """One character per token, between ``^`` and ``$``."""
    return f"^{_LEX[language](text)}$"


def _all(before: str, after: str) -> set[str]:
    return {a + b for a in before for b in after}


@cache
def neighbours(language: str) -> frozenset[str]:
    """The pairs of neighbouring tokens that the grammar permits."""
    if language == "python":
        ends, begins, opens = "i0sm)]}", "i0sm([{-~*K", "([{"
        out = _all(ends, "o-*/@=.,:;)]}nK([$") | _all("i)]m", "([") | _all("m", begins + "F") | _all("i", "m") | {"ss", "}K"}
        out |= _all("o-~/@=", begins) | _all("*", begins) | _all("*", ",):=") | _all("/", "),:") | _all(",:;", begins + "F)]}n$@") | _all(",:", "/:,=") | _all(opens, begins + ")]}:n/")
        out |= _all("K", begins + ".:,;)]}n$o(=[") | _all("F", ":;n$K") | _all("n^", begins + "F@n$.,:;)]}o=/") | _all("o-~*/@=.,:;([{)]}KFi0sm", "n") | _all(".", "i.mKn") | {"^n"} | _all("K", "F")
        return frozenset(out - {",,", "(,", ":;"} | {":,"})
    if language == "json":
        begin, end = "{[s0k-", "}]s0k"
        return frozenset(_all("^:,[", begin) | _all(end, "$,}]") | {"{s", "{}", "[]", "s:", "-k"})
    if language == "xml":
        inner = "CPDSEMT"
        return frozenset(_all(inner, inner) | _all("^", "P!CSM") | _all("!", "CPSM") | _all("CP", "!") | _all("EMCP", "$") - {"^D", "^T"})
    if language == "ini":
        return frozenset({"^[", "^$"} | _all("[", "[k$") | _all("k+", "k+[$"))
    if language == "yaml":
        return frozenset(_all("^kd-s", "kd-s$"))
    if language == "sql":
        every = "i0sKfob*.,;:()?$"
        never = _all("(", ",") | _all(",", ",);f") | _all("o", ");") | _all("Kf", ");") | {",$", "o$", "K$", "f$"}
        return frozenset((_all("^" + every, every)) - never)
    every = "wn;&AD(){}$"
    never = _all("A", ";A&D)}$") | _all("^n({;&D$", "A") | _all("^;&({n", ";") | _all("^(;&", "&") | {"&;", "^D"}
    return frozenset(_all("^" + every, every) - never)

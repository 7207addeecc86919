"""Names and marks of the programming languages in the data."""

from __future__ import annotations

import re

#: Spellings of language names.
SPELLINGS = {
    "python": "python py python3 py3 python2",
    "javascript": "javascript js node nodejs ecmascript mjs jsx",
    "typescript": "typescript ts tsx",
    "java": "java",
    "c++": "c++ cpp cplusplus cxx cc c-plus-plus hpp",
    "c": "c h ansi-c c99",
    "go": "go golang",
    "rust": "rust rs",
    "shell": "shell sh bash zsh shellscript shell-script",
    "sql": "sql mysql postgresql postgres sqlite plsql",
    "json": "json jsonc",
    "yaml": "yaml yml",
    "xml": "xml xsd xsl",
    "ini": "ini cfg conf properties",
    "markdown": "markdown md mdown",
}
_OF = {s: name for name, all_ in SPELLINGS.items() for s in all_.split()}
#: Languages whose files are data or documents by nature.
DATA = frozenset("json yaml xml ini markdown".split())


def language_of(name: str | None) -> str | None:
    """The language meant by any spelling; None for null and blank; unknown names pass in lower case."""
    s = (name or "").strip().lower()
    return _OF.get(s, s) or None


#: Marks that lines of a language bear, and lines of the others rarely do.
_MARKS = {
    "python": r"^\s*(?:def \w+\(.*\)(?: ->.*)?:|from [\w.]+ import |import [\w.]+(?: as \w+)?\s*$|class \w+.*:\s*$|elif .*:|except\b.*:|if .*:\s*$|for \w+ in .*:\s*$|with .*:\s*$|log = |@\w+\s*$|try:\s*$)",
    "javascript": r"^\s*(?:(?:const|let|var) [\w{} ,]+ = require\(|module\.exports|function \w*\([\w, ]*\) \{|(?:const|let) \w+ = |exports\.|[\w.]+\(.*=> \{|console\.log)",
    "typescript": r"^\s*(?:import (?:type )?\{.*\} from |export (?:default |async )?(?:function|const|class|interface|type) |interface \w+ \{|(?:const|let) \w+: [\w\[\]<>]+ = |\w+\??: (?:string|number|boolean|any|void)(?:\[\])?;|.*\)\s*:\s*(?:string|number|boolean|any|void)\b)",
    "java": r"^\s*(?:package [\w.]+;|import (?:static )?[\w.*]+;|(?:public|private|protected) (?:static |final |class |interface |void |int |String |boolean |[A-Z]\w*)|@Override|this\.\w+ = |logger\.|final \w+ )",
    "c++": r"^\s*(?:#include <(?:vector|string|iostream|map|memory|algorithm|unordered_map|set|utility|optional)>|#include \"[\w/]+\.hpp\"|namespace \w+|using namespace|std::|auto\s*&?\s*\w+ = |template\s*<|for \(auto|.*\bstd::|class \w+ \{|constexpr |.*\.push_back\()",
    "c": r"^\s*(?:#include <(?:stdio|stdlib|string|stdint|stddef|math|assert|errno)\.h>|#include \"[\w/]+\.h\"|static (?:int|void|char|const|double)|printf\(|.*->\w+ = |#define |typedef struct|struct \w+ \{|(?:int|void|char|double) \*?\w+\(.*\) \{)",
    "go": r"^\s*(?:package \w+\s*$|func (?:\(.*\) )?\w+\(|import (?:\(|\")|\w+(?:, \w+)* := |log\.Print|fmt\.|if err != nil|for \w+ := |for _, \w+ := |var \w+ = |type \w+ struct)",
    "rust": r"^\s*(?:use (?:crate|std|super)::|pub (?:fn|struct|enum|mod) |fn \w+\(.*\)(?: -> .*)? \{|let (?:mut )?\w+ = |println!\(|impl\b|match \w+ \{|for \w+ in .*\{|if [^()]* \{\s*$|#\[\w+|mod \w+;|const \w+: &)",
    "shell": r"^\s*(?:#!/(?:usr/)?bin/|set -[eux]|echo |fi\s*$|done\s*$|then\s*$|if \[|for \w+ in .*; do|local \w+=|export \w+=|\w+\(\) \{|\w+=\"?\$|esac\s*$|cp \"|while .*; do)",
    "sql": r"(?i)^\s*(?:select\b.*|insert into |create (?:table|index|view|or replace)|update \w+|delete from |alter table |drop table |from \w+|where\b|set \w+ = |group by |order by |\w+ (?:bigint|varchar|numeric|integer|date|text|timestamp)\b.*,?|values\b|(?:left |inner )?join |primary key|commit;)",
    "json": r"^\s*(?:\"[^\"]*\"\s*:\s*.*,?\s*$|[\[{]\s*$|[\]}],?\s*$)",
    "yaml": r"^(?:\s*(?:- )?[\w-]+:(?:\s+.*)?$|\s*- [\w-]+\s*$|---\s*$)",
    "xml": r"^\s*(?:<\?xml|</?[A-Za-z][\w:.-]*(?:\s[^>]*)?/?>)",
    "ini": r"^(?:\[[^\]\"]+\]\s*$|[\w.-]+ ?= ?[^;{(]*$)",
    "markdown": r"^(?:#{1,6} \S|[-*] [A-Z]|\d+\. |```|> |\|.*\|)",
}
MARKS = {k: re.compile(v) for k, v in _MARKS.items()}
#: Languages that share most of their marks: of these the richer one is named only if its own marks show.
_KIN = {("javascript", "typescript"), ("c", "c++")}


def likely(lines: list[str]) -> dict[str, float]:
    """The share of the lines that bear the marks of each language."""
    lines = [x for x in lines if x.strip()]
    n = max(1, len(lines))
    return {k: sum(1 for x in lines if r.match(x)) / n for k, r in MARKS.items()}

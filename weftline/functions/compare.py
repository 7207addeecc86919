"""Language-aware equivalence of two files.

SQL decides first: texts that are equal after line ends are made alike are the
same in every language, and plain text, Markdown, SQL and HTML are compared by
their normal forms. Only what is left reaches one Arrow function. An exception
in a comparison is a defined result, never a failed job: the texts differ.
"""

from __future__ import annotations

import configparser
import io
import json
import re
import xml.etree.ElementTree as ET
from functools import cache
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import text as T

try:
    import yaml
except ImportError:
    yaml = None
try:
    from pygments.lexers import get_lexer_by_name
    from pygments.util import ClassNotFound
except ImportError:
    get_lexer_by_name = None

#: Languages that SQL compares alone.
BY_FORM = {"text": T.text_form, "markdown": T.markdown_form, "sql": T.sql_form}


def _bare_equal(a: str, b: str) -> bool:
    return a.strip() == b.strip()


def json_equal(a: str, b: str) -> bool:
    """Python equality of the parsed values: key order is free, 1 equals true, the last of repeated keys counts."""
    try:
        return json.loads(a) == json.loads(b)
    except ValueError:
        return _bare_equal(a, b)


def yaml_equal(a: str, b: str) -> bool:
    """Equality of all documents; a value that can't be made (an impossible date) compares as text."""
    if yaml is None:
        return _text_form(a) == _text_form(b)
    try:
        return list(yaml.safe_load_all(a)) == list(yaml.safe_load_all(b))
    except (yaml.YAMLError, ValueError, TypeError):
        return _bare_equal(a, b)


def _text_form(s: str) -> str:
    return re.sub(r"[ \t]+(?=\n|\Z)", "", s).rstrip("\n")


def _tree(node: ET.Element) -> tuple:
    return node.tag, tuple(sorted(node.attrib.items())), (node.text or "").strip(), tuple(map(_tree, node))


def xml_equal(a: str, b: str) -> bool:
    """Same tags, attributes in any order, stripped text and children; text after a child doesn't count."""
    try:
        return _tree(ET.fromstring(a.strip())) == _tree(ET.fromstring(b.strip()))
    except (ET.ParseError, ValueError, RecursionError):
        return _bare_equal(a, b)


def html_equal(a: str, b: str) -> bool:
    try:
        return _tree(ET.fromstring(a.strip())) == _tree(ET.fromstring(b.strip()))
    except (ET.ParseError, ValueError, RecursionError):
        return False


def ini_equal(a: str, b: str) -> bool:
    """Same sections with the same items, values interpolated; any error compares the texts."""
    try:
        left, right = configparser.ConfigParser(), configparser.ConfigParser()
        left.read_file(io.StringIO(a))
        right.read_file(io.StringIO(b))
        if set(left.sections()) != set(right.sections()) or left.defaults() != right.defaults():
            return False
        return all(dict(left.items(s)) == dict(right.items(s)) for s in left.sections())
    except (configparser.Error, ValueError):
        return _bare_equal(a, b)


@cache
def _lexer(name: str):
    try:
        return get_lexer_by_name(name) if get_lexer_by_name else None
    except ClassNotFound:
        return None


#: Names of lexers that differ from those of the languages.
LEXERS = {"shell": "bash", "c++": "cpp", "csharp": "csharp"}


def token_equal(a: str, b: str, language: str | None) -> bool:
    """The same tokens, blanks aside, so indentation doesn't count; without a lexer the stripped texts.

    Tokens that aren't blank make up all other characters in order, so texts that
    differ in these can't be equal and aren't lexed; else both are lexed until the first difference.
    """
    lexer = _lexer(LEXERS.get(language, language)) if language else None
    if lexer is None:
        return _bare_equal(a, b)
    if "".join(a.removeprefix("\ufeff").split()) != "".join(b.removeprefix("\ufeff").split()):
        return False
    tokens = lambda s: ((k, v) for k, v in lexer.get_tokens(s) if v.strip())
    return all(x == y for x, y in zip_longest(tokens(a), tokens(b)))


_BY_PARSE = {"json": json_equal, "yaml": yaml_equal, "xml": xml_equal, "html": html_equal, "ini": ini_equal}


def same(a: str | None, b: str | None, language: str | None) -> bool:
    """The comparison of one pair whose forms differ; ``language`` is a known name."""
    if a is None or b is None:
        return False
    if language in _BY_PARSE:
        return _BY_PARSE[language](a, b)
    return token_equal(a, b, language)


@F.pandas_udf(BooleanType())
def _same(a: pd.Series, b: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([same(x, y, g) for x, y, g in zip(a, b, language)], dtype=bool)


def form_equal(a: Column, b: Column, language: Column) -> Column:
    """What SQL alone can say: true, false (for languages compared by form) or null (to be parsed)."""
    a, b = T.newlines(a), T.newlines(b)
    out = F.when(a.isNull() | b.isNull(), False).when(a == b, True)
    for name, form in BY_FORM.items():
        out = out.when(language == name, form(a) == form(b))
    return out.when((language == "html") & (T.html_form(a) == T.html_form(b)), True)


def score(df: DataFrame, prediction: str, truth: str, language: str, clean: bool = False, name: str = "score") -> DataFrame:
    """``df`` with ``name``, 1.0 where the prediction equals the truth, else 0.0.

    One pass: the function gets nulls for the rows that SQL has decided, so their
    texts are neither sent to Python nor scanned again.
    ``clean`` deletes all markers before the wrapper is stripped.
    """
    got = T.marker_clean(prediction) if clean else F.col(prediction)
    df = df.withColumns({"_a": T.newlines(T.wrapper_strip(got)), "_b": T.newlines(truth), "_g": T.language(language)})
    df = df.withColumn("_known", form_equal(F.col("_a"), F.col("_b"), F.col("_g")))
    open_ = lambda c: F.when(F.col("_known").isNull(), F.col(c))
    return df.withColumn(name, F.coalesce("_known", _same(open_("_a"), open_("_b"), open_("_g"))).cast("double")).drop("_a", "_b", "_g", "_known")

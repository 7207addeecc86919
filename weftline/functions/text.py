"""Text functions as Column expressions: tags, wrappers, markers, lines and normal forms.

Everything here stays in the JVM and inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "<update_file>", "</update_file>"
#: Marker strings that are deleted from predictions, in this order.
MARKERS = (
    "<update_code>", "</update_code>", "<updated-code>", "</updated-code>", "<update_file>\n", "<update_file>", "</update_file>", "</think>\n", "</think>",
)
#: File extensions of languages.
EXTENSIONS = {
    "python": "py", "javascript": "js", "java": "java", "c++": "cpp", "c": "c", "go": "go", "typescript": "ts", "csharp": "cs", "rust": "rs", "json": "json", "yaml": "yaml", "xml": "xml",
    "sql": "sql", "ini": "ini", "markdown": "md", "text": "txt", "html": "html", "restructuredtext": "rst", "shell": "sh", "dockerfile": "dockerfile", "makefile": "makefile",
}
#: Names under which languages also occur.
ALIASES = {
    "py": "python", "python3": "python", "js": "javascript", "ts": "typescript", "cpp": "c++", "cplusplus": "c++", "golang": "go", "rs": "rust", "sh": "shell", "bash": "shell",
    "yml": "yaml", "md": "markdown", "c#": "csharp", "cs": "csharp", "plain": "text", "txt": "text", "rst": "text",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def language(c: Column | str) -> Column:
    """Lower case without blanks at the ends, known aliases by their language; null stays null."""
    s = F.lower(F.trim(col(c)))
    known = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, s), s)


def report_language(c: Column | str) -> Column:
    """The language shown in reports: null and blank are ``unknown``."""
    return F.coalesce(F.nullif(language(c), F.lit("")), F.lit("unknown"))


def extension(c: Column | str, other: Column | None = None) -> Column:
    """The extension of a language; ``other`` (default: the language itself) if unknown."""
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    s = language(c)
    return F.coalesce(F.try_element_at(known, s), other if other is not None else s)


def newlines(c: Column | str) -> Column:
    """X11: CR LF and CR become LF."""
    return F.regexp_replace(col(c), "\r\n?", "\n")


def occurrences(c: Column, what: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)).cast("int")


def wrapper_strip(c: Column | str) -> Column:
    """What follows the first opening tag, up to the last closing tag; all of it without tags."""
    c = col(c)
    at = F.instr(c, OPEN)
    body = F.when(at > 0, c.substr(at + len(OPEN), F.length(c))).otherwise(c)
    return F.when(F.contains(body, F.lit(CLOSE)), F.regexp_extract(body, f"(?s)\\A(.*){CLOSE}", 1)).otherwise(body)


def wrapper_parse(c: Column | str) -> Column:
    """Counts of tags, whether both stand in order, the content and the text outside."""
    c = F.coalesce(col(c), F.lit(""))
    start = F.instr(c, OPEN)
    tail = F.when(start > 0, c.substr(start + len(OPEN), F.length(c))).otherwise(F.lit(""))
    ended = (start > 0) & F.contains(tail, F.lit(CLOSE))
    inner = F.when(ended, F.regexp_extract(tail, f"(?s)\\A(.*){CLOSE}", 1)).when(start > 0, tail).otherwise(c)
    after = F.when(ended, tail.substr(F.length(inner) + len(CLOSE) + 1, F.length(c))).otherwise(F.lit(""))
    before = F.when(start > 0, c.substr(F.lit(1), start - 1)).otherwise(F.lit(""))
    outside = F.when(start > 0, strip(F.concat(before, F.lit("\n"), after))).otherwise(F.lit(""))
    return F.struct(
        occurrences(c, OPEN).alias("opens"), occurrences(c, CLOSE).alias("closes"), (start > 0).alias("has_start"), ended.alias("has_end"),
        inner.alias("content"), outside.alias("outside"), F.substring(outside, 1, 300).alias("excerpt"),
    )


def strip(c: Column | str) -> Column:
    """Without blanks and line ends at both ends."""
    return F.regexp_replace(col(c), r"\A[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+\z", "")


def marker_clean(c: Column | str) -> Column:
    """All markers deleted, no-break spaces made plain; null gives an empty text."""
    out = F.coalesce(col(c), F.lit(""))
    for m in MARKERS:
        out = F.replace(out, F.lit(m), F.lit(""))
    return F.replace(out, F.lit(" "), F.lit(" "))


def tag_first(c: Column | str, tag: str, missing: Column | None = None) -> Column:
    """The block after the first ``<tag>``, up to the next ``</tag>`` or the end; ``missing`` without one."""
    c = col(c)
    block = F.split_part(F.regexp_extract(c, f"(?s)<{tag}>(.*)", 1), F.lit(f"</{tag}>"), F.lit(1))
    return F.when(F.contains(c, F.lit(f"<{tag}>")), strip(block)).otherwise(missing if missing is not None else F.lit(None).cast("string"))


def tag_strict(c: Column | str, *tags: str) -> Column:
    """The first of ``tags`` that opens and closes, unstripped; else an empty text."""
    c = col(c)
    out = F.lit("")
    for tag in reversed(tags):
        block = F.regexp_extract(c, f"(?s)<{tag}>(.*?)</{tag}>", 1)
        out = F.when(c.rlike(f"(?s)<{tag}>.*?</{tag}>"), block).otherwise(out)
    return out


def tag_all(c: Column | str, tag: str) -> Column:
    """All complete blocks joined and stripped; an empty text without any."""
    return strip(F.array_join(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), ""))


def text_form(c: Column | str) -> Column:
    """The normal form of plain text: no blanks at line ends, no empty lines at the end."""
    c = F.regexp_replace(newlines(c), r"[ \t\f\x0b]+(?=\n|\z)", "")
    return F.regexp_replace(c, r"\n+\z", "")


def markdown_form(c: Column | str) -> Column:
    """As plain text, with runs of empty lines as one and none at either end."""
    c = F.regexp_replace(text_form(c), r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"\A\n+|\n+\z", "")


def sql_form(c: Column | str) -> Column:
    """Blanks as one, lower case."""
    return F.lower(F.trim(F.regexp_replace(col(c), r"\s+", " ")))


def html_form(c: Column | str) -> Column:
    """E4, first stage: blanks between tags and before a closing slash don't count, nor does case."""
    c = F.regexp_replace(F.regexp_replace(col(c), r"\s+", " "), r">\s+<", "><")
    return F.lower(F.trim(F.regexp_replace(c, r"\s*/\s*>", "/>")))


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\n")


def numbered(c: Column | str, style: str = "padded") -> Column:
    """Lines with numbers: ``padded`` (`` 1 | x``), ``right`` (`` 1| x``) or ``label`` (``L1:x``)."""
    parts = lines(c)
    width = F.length(F.size(parts).cast("string"))
    form = {
        "padded": lambda x, i: F.concat(F.lpad((i + 1).cast("string"), width, F.lit(" ")), F.lit(" | "), x),
        "right": lambda x, i: F.concat(F.lpad((i + 1).cast("string"), width, F.lit(" ")), F.lit("| "), x),
        "label": lambda x, i: F.concat(F.lit("L"), (i + 1).cast("string"), F.lit(":"), x),
    }[style]
    return F.array_join(F.transform(parts, form), "\n")


def is_numbered(c: Column | str) -> Column:
    """whether the non-blank ones of the first five lines all begin with a number and a bar."""
    head = F.filter(F.slice(lines(c), 1, 5), lambda x: F.trim(x) != "")
    return (F.size(head) > 0) & F.forall(head, lambda x: x.rlike(r"^\s*\d+\| "))


def middle_cut(c: Column | str, most: int) -> Column:
    """Head and tail of a long text around a mark that gives its length."""
    c = col(c)
    half = most // 2
    mark = F.concat(F.lit("\n... (content truncated, total_chars="), F.length(c).cast("string"), F.lit(") ...\n"))
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(half)), mark, F.right(c, F.lit(most - half))))


def informative(c: Column) -> Column:
    """a line that tells something: more than 3 characters, not all punctuation, no placeholder."""
    s = strip(c)
    return (F.length(s) > 3) & ~s.rlike(r"^[{}\[\]();,:+\-*/=<>|&!.]+$") & ~F.lower(s).rlike("existing code|more code")


PLACEHOLDER = r"(?im)^[ \t]*(?://|#|;|--)?[ \t]*\.\.\.[ \t]*(?:(?:existing|more)[ \t]*code[ \t]*\.\.\.)?[ \t]*$"


def placeholders(c: Column | str, most: int = 5) -> Column:
    """the lines that stand for code left out, at most ``most``."""
    found = F.regexp_extract_all(F.coalesce(newlines(c), F.lit("")), F.lit(PLACEHOLDER), F.lit(0))
    return F.slice(F.transform(found, lambda x: F.trim(x)), 1, most)


def looks_like_diff(c: Column | str) -> Column:
    """F16: a hunk header or both file headers."""
    c = col(c)
    return c.rlike(r"(?m)^@@\s+-\d+") | (c.rlike(r"(?m)^--- ") & c.rlike(r"(?m)^\+\+\+ "))


def diff_body(c: Column | str) -> Column:
    """struct(body, error): the diff in its tag, or the text if it looks like one, without a fence."""
    c = col(c)
    tagged = F.regexp_extract(c, r"(?s)<unified_diff>(.*)</unified_diff>", 1)
    raw = F.when(c.rlike(r"(?s)<unified_diff>.*</unified_diff>"), tagged).when(looks_like_diff(c), c)
    bare = F.regexp_replace(raw, r"(?s)\A\s*```[^\n]*\n(.*?)\n?```\s*\z", "$1")
    body = F.concat(F.regexp_replace(bare, r"\n+\z", ""), F.lit("\n"))
    error = F.when(c.isNull() | (strip(c) == ""), "empty output").when(raw.isNull(), "no diff found").when(strip(bare) == "", "empty diff")
    return F.struct(F.when(error.isNull(), body).alias("body"), error.alias("error"))


def think_strip(c: Column | str) -> Column:
    """Reasoning blocks removed."""
    return F.regexp_replace(col(c), r"(?is)<think[^>]*>.*?</think>", "")


def fences(c: Column | str) -> Column:
    """Contents of fenced blocks, JSON ones first, repeats dropped."""
    c = F.coalesce(col(c), F.lit(""))
    first = F.regexp_extract_all(c, F.lit(r"(?s)```(?:json|jsonc)[ \t]*\n(.*?)```"), F.lit(1))
    every = F.regexp_extract_all(c, F.lit(r"(?s)```[^\n`]*\n(.*?)```"), F.lit(1))
    return F.array_union(first, every)


def json_object(c: Column | str) -> Column:
    """The text from the first ``{`` to the last ``}`` as a variant; null if that is no object."""
    text = F.regexp_extract(col(c), r"(?s)(\{.*\})", 1)
    return F.try_parse_json(F.nullif(text, F.lit("")))


def truth(c: Column | str) -> Column:
    """True, 1, yes, y; false, 0, no, n; anything else is null."""
    s = F.lower(F.trim(col(c).cast("string")))
    return F.when(s.isin("true", "1", "yes", "y"), True).when(s.isin("false", "0", "no", "n"), False)


def confidence(c: Column | str, default: float = 0.5) -> Column:
    """A number from 0 to 1; ``default`` if it is none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(col(c).try_cast("double"), F.lit(default))))


def file_language(c: Column | str) -> Column:
    """The language in the name of a prediction file: before a trailing date and time, else the last but one part."""
    parts = F.split(F.regexp_replace(col(c), r"\.jsonl$", ""), "_")
    n = F.size(parts)
    stamped = (n >= 3) & F.element_at(parts, -1).rlike(r"^\d{6}$") & F.try_element_at(parts, F.lit(-2)).rlike(r"^\d{8}$")
    return F.when(n < 2, "python").when(stamped, F.try_element_at(parts, F.lit(-3))).otherwise(F.try_element_at(parts, F.lit(-2)))


def percent(part: Column, whole: Column) -> Column:
    """A share in percent with two decimals; 0 for an empty whole."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, 2)).otherwise(F.lit(0.0))


def blank(c: Column | str) -> Column:
    return col(c).isNull() | (strip(c) == "")

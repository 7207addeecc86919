"""H1-H7: applying search-and-replace edits and unified diffs to a file.

A strategy turns the text to be replaced into candidate spans of the content.
Strategies are tried from strict to lenient; the first whose candidate occurs
only once in the content decides, or, for edits of all occurrences, the first
with any candidate.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

Span = tuple[int, int]

#: Messages that reports group errors by.
NOT_FOUND = "Could not find oldString in the file. It must match exactly, including whitespace, indentation, and line endings."
AMBIGUOUS = "Found multiple matches for oldString. Provide more surrounding context to make the match unique."
NO_CHANGE = "No changes to apply: oldString and newString are identical."
NOT_JSON = "Patch is not valid JSON and no JSON object/array could be extracted."
#: Least similarity of a block between matching first and last lines, for several candidates.
AMONG_SEVERAL = 0.3
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class PatchError(ValueError):
    pass


class _Page:
    """A content with the offsets of its lines."""

    def __init__(self, content: str):
        self.content = content
        self.lines = content.split("\n")
        self.starts = [0]
        for x in self.lines:
            self.starts.append(self.starts[-1] + len(x) + 1)

    def span(self, first: int, after: int) -> Span:
        return self.starts[first], self.starts[after] - 1

    def windows(self, n: int, same: Callable[[list[str]], bool]) -> Iterator[Span]:
        for i in range(len(self.lines) - n + 1):
            if same(self.lines[i : i + n]):
                yield self.span(i, i + n)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance."""
    if not a or not b:
        return max(len(a), len(b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = row[0]
        row[0] = i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def literal(page: _Page, find: str) -> Iterator[Span]:
    at = page.content.find(find)
    if at >= 0:
        yield at, at + len(find)


def every_literal(page: _Page, find: str) -> Iterator[Span]:
    at = page.content.find(find)
    while at >= 0 and find:
        yield at, at + len(find)
        at = page.content.find(find, at + len(find))


def _wanted(find: str) -> list[str]:
    """The lines to find, without the empty one after a last line end."""
    rows = find.split("\n")
    return rows[:-1] if len(rows) > 1 and rows[-1] == "" else rows


def trimmed_lines(page: _Page, find: str) -> Iterator[Span]:
    want = [x.strip() for x in _wanted(find)]
    yield from page.windows(len(want), lambda rows: [x.strip() for x in rows] == want)


def anchored(page: _Page, find: str) -> Iterator[Span]:
    """First and last line match; among several blocks the one with the most similar inside."""
    if find.count("\n") < 2:
        return
    want = [x.strip() for x in _wanted(find)]
    bare = [x.strip() for x in page.lines]
    blocks = []
    for i, x in enumerate(bare):
        if x == want[0]:
            end = next((j for j in range(i + 2, len(bare)) if bare[j] == want[-1]), None)
            if end is not None:
                blocks.append((i, end))

    def alike(block: tuple[int, int]) -> float:
        inner = list(zip(bare[block[0] + 1 : block[1]], want[1:-1]))
        if not inner:
            return 1.0
        return sum(1 - edit_distance(a, b) / max(len(a), len(b)) for a, b in inner if a or b) / len(inner)

    if len(blocks) > 1:
        best = max(blocks, key=alike)
        blocks = [best] if alike(best) >= AMONG_SEVERAL else []
    for i, j in blocks:
        yield page.span(i, j + 1)


def _spaces(s: str) -> str:
    return " ".join(s.split())


def blank_runs(page: _Page, find: str) -> Iterator[Span]:
    """Equal when runs of blanks are one: a line, part of a line, or a block of as many lines."""
    want = _spaces(find)
    pattern = re.compile(r"\s+".join(map(re.escape, want.split()))) if want else None
    for i, line in enumerate(page.lines):
        have = _spaces(line)
        if have == want:
            yield page.span(i, i + 1)
        elif pattern and want in have and (m := pattern.search(line)):
            yield page.starts[i] + m.start(), page.starts[i] + m.end()
    if "\n" in find:
        yield from page.windows(find.count("\n") + 1, lambda rows: _spaces("\n".join(rows)) == want)


def _flush_left(rows: list[str]) -> list[str]:
    depth = min((len(x) - len(x.lstrip()) for x in rows if x.strip()), default=0)
    return [x[depth:] if x.strip() else x for x in rows]


def shifted(page: _Page, find: str) -> Iterator[Span]:
    """Equal after the common indentation is taken off."""
    want = _flush_left(find.split("\n"))
    yield from page.windows(len(want), lambda rows: _flush_left(rows) == want)


def _unescape(s: str) -> str:
    return re.sub(r"\\([ntr'\"`\\\n$])", lambda m: _ESCAPES.get(m.group(1), m.group(1)), s)


def unescaped(page: _Page, find: str) -> Iterator[Span]:
    want = _unescape(find)
    if want:
        yield from literal(page, want)
    yield from page.windows(want.count("\n") + 1, lambda rows: _unescape("\n".join(rows)) == want)


def trimmed_ends(page: _Page, find: str) -> Iterator[Span]:
    want = find.strip()
    if want == find:
        return
    if want:
        yield from literal(page, want)
    yield from page.windows(find.count("\n") + 1, lambda rows: "\n".join(rows).strip() == want)


def half_alike(page: _Page, find: str) -> Iterator[Span]:
    """Anchors match, the sizes are equal and at least half of the inner lines."""
    if find.count("\n") < 2:
        return
    want = [x.strip() for x in _wanted(find)]
    bare = [x.strip() for x in page.lines]
    for i, x in enumerate(bare):
        if x != want[0]:
            continue
        end = next((j for j in range(i + 2, len(bare)) if bare[j] == want[-1]), None)
        if end is not None and end - i + 1 == len(want):
            inner = [(a, b) for a, b in zip(bare[i + 1 : end], want[1:-1]) if a or b]
            if not inner or sum(a == b for a, b in inner) >= len(inner) / 2:
                yield page.span(i, end + 1)


STRATEGIES = (literal, trimmed_lines, anchored, blank_runs, shifted, unescaped, trimmed_ends, half_alike, every_literal)


def replace(content: str, old: str, new: str, everywhere: bool = False) -> str:
    """H3: one edit; raises PatchError if nothing matches or no match is unique."""
    if old == new:
        raise PatchError(NO_CHANGE)
    page, seen = _Page(content), False
    for strategy in STRATEGIES:
        for start, end in strategy(page, old):
            piece = content[start:end]
            first = content.find(piece)
            seen = True
            if everywhere:
                return content.replace(piece, new)
            if first == content.rfind(piece):
                return content[:first] + new + content[first + len(piece) :]
    raise PatchError(AMBIGUOUS if seen else NOT_FOUND)


def _shaped(value: object) -> bool:
    """Whether a value looks like a patch."""
    if isinstance(value, dict):
        return _shaped(value["edits"]) if isinstance(value.get("edits"), list) else "edits" not in value and {"oldString", "newString"} <= value.keys()
    return isinstance(value, list) and bool(value) and all(isinstance(x, dict) and "oldString" in x and "newString" in x for x in value)


def find_json(text: str) -> object:
    """The patch in a model's answer: the whole text, a fenced block, or the first value that looks like one."""
    bare = re.sub(r"(?is)<think[^>]*>.*?</think>", "", text).strip()
    fenced = re.findall(r"(?s)```(?:json|jsonc)[ \t]*\n(.*?)```", bare) + re.findall(r"(?s)```[^\n`]*\n(.*?)```", bare)
    for part in (bare, *dict.fromkeys(fenced)):
        try:
            return json.loads(part)
        except ValueError:
            continue
    other, decoder = None, json.JSONDecoder()
    for m in re.finditer(r"[\[{]", bare):
        try:
            value, _ = decoder.raw_decode(bare, m.start())
        except ValueError:
            continue
        if _shaped(value):
            return value
        other = value if other is None else other
    if other is None:
        raise PatchError(NOT_JSON)
    return other


def parse_edits(patch: object) -> list[tuple[str, str, bool]]:
    """H1: (old, new, everywhere) of each edit."""
    value = find_json(patch) if isinstance(patch, str) else patch
    if isinstance(value, dict) and isinstance(value.get("edits"), list):
        value = value["edits"]
    if isinstance(value, dict):
        value = [value]
    if not isinstance(value, list):
        raise PatchError(f"Unexpected patch JSON type: {type(value).__name__}")
    out = []
    for n, x in enumerate(value, 1):
        if not isinstance(x, dict):
            raise PatchError(f"Patch item #{n} is not an object: {type(x).__name__}")
        if "oldString" not in x or "newString" not in x:
            raise PatchError(f"Patch item #{n} must contain oldString and newString.")
        out.append((str(x["oldString"]), str(x["newString"]), bool(x.get("replaceAll", False))))
    return out


def apply_edits(original: str, patch: object) -> str:
    """H2: all edits in turn, with the line ends of the file; an empty old text replaces the file."""
    crlf = "\r\n" in original
    ends = lambda s: s.replace("\r\n", "\n").replace("\n", "\r\n") if crlf else s.replace("\r\n", "\n")
    out = original
    for old, new, everywhere in parse_edits(patch):
        out = ends(new) if old == "" else replace(out, ends(old), ends(new), everywhere)
    return out


_HUNK = re.compile(r"^@@\s+-(\d+)(?:,(\d+))?\s+\+(\d+)(?:,(\d+))?\s+@@")


def hunks(patch: str) -> list[tuple[int, str, list[str]]]:
    """H4: (first line, header counts, body) of each hunk; counts aren't enforced."""
    patch = patch.replace("\r\n", "\n").replace("\r", "\n")
    if len(re.findall(r"(?m)^diff --git\s+", patch)) > 1:
        raise PatchError("Expected single-file patch, got multiple diff --git sections")
    out: list[tuple[int, str, list[str]]] = []
    open_ = False
    for line in patch.splitlines():
        if m := _HUNK.match(line):
            if out and not out[-1][2]:
                break
            out.append((int(m[1]), f"-{m[1]},{m[2] or 1} +{m[3]},{m[4] or 1}", []))
            open_ = True
        elif open_ and line[:1] in (" ", "+", "-", "\\") and line[:1]:
            out[-1][2].append(line)
        else:
            open_ = False
    for first, _, body in out:
        if not body:
            raise PatchError(f"Empty hunk body near source line {first}")
    return out


def apply_diff(original: str, patch: str) -> str:
    """H5: each hunk at its line, shifted by the hunks before, else where its old lines stand once."""
    lines = original.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    shift = 0
    for first, header, body in hunks(patch):
        old = [x[1:] for x in body if x[0] in " -"]
        new = [x[1:] for x in body if x[0] in " +"]
        hint = first - 1 + shift
        if not old:
            at = max(0, min(hint, len(lines)))
        elif hint >= 0 and lines[hint : hint + len(old)] == old:
            at = hint
        else:
            spots = [i for i in range(len(lines) - len(old) + 1) if lines[i] == old[0] and lines[i : i + len(old)] == old]
            if len(spots) != 1:
                raise PatchError(f"Hunk failed to apply (no unique match). Hint line={hint + 1}, hunk_header={header}")
            at = spots[0]
        lines[at : at + len(old)] = new
        shift += len(new) - len(old)
    return "\n".join(lines)


RESULT = StructType([StructField("result", StringType()), StructField("error", StringType())])


def _safely(apply: Callable[[str, str], str], original: str | None, patch: str | None) -> tuple[str | None, str | None]:
    if patch is None or not patch.strip():
        return None, "Empty model output"
    try:
        return apply(original or "", patch), None
    except PatchError as e:
        return None, str(e)
    except Exception as e:  # one bad row is a result, not the end of the job
        return None, f"Unexpected apply error: {e}"


@F.pandas_udf(RESULT)
def sar_apply(original: pd.Series, patch: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_safely(apply_edits, a, p) for a, p in zip(original, patch)], columns=["result", "error"])


@F.pandas_udf(RESULT)
def udiff_apply(original: pd.Series, patch: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_safely(apply_diff, a, p) for a, p in zip(original, patch)], columns=["result", "error"])


def wrap(c: Column) -> Column:
    """H6: a file in its wrapper; an empty wrapper for null."""
    return F.concat(F.lit("<update_file>"), F.coalesce(c, F.lit("")), F.lit("</update_file>"))


def sar_error(c: Column) -> Column:
    """H7: struct(kind, category) of an error message of search-and-replace."""
    m = F.trim(c)
    category = (
        F.when(c.isNull(), "ok").when(m == "", "ok_empty_apply_error").when(m == "Empty model output", "empty_model_output").when(m.startswith("Unexpected apply error:"), "unexpected_apply_error")
        .when(m == NOT_JSON, "patch_invalid_json").when(m.startswith("Unexpected patch JSON type:"), "patch_unexpected_json_type")
        .when(m.startswith("Patch item #") & m.contains(" is not an object:"), "patch_item_not_object").when(m.startswith("Patch item #") & m.contains(" must contain oldString and newString."), "patch_item_missing_fields")
        .when(m == NO_CHANGE, "no_changes_to_apply").when(m.startswith("Could not find oldString in the file."), "oldstring_not_found").when(m.startswith("Found multiple matches for oldString."), "oldstring_multiple_matches")
        .otherwise("other_sar_error")
    )
    kind = F.when(category.startswith("ok"), "ok").when(category.isin("empty_model_output", "unexpected_apply_error"), "non_sar").otherwise("sar")
    return F.struct(kind.alias("kind"), category.alias("category"))

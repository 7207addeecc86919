"""Line differences and what they say about an edit."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

REACH, BUFFER, FAR = 30, 3, 30  # lines around an anchor, around an edit, and from where a match is misplaced
PATCH_PENALTY, SIDE_PENALTY = 0.25, 0.35
#: How many of a signature's places count, and how many edits and strays a summary shows.
SPOTS, SHOWN_EDITS, SHOWN_STRAYS = 50, 50, 30

#: A line of these characters alone tells nothing.
_NOISE = re.compile(r"^[{}\[\]();,:+\-*/=<>|&!.]+$")


def opcodes(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Ratcliff-Obershelp opcodes; lines frequent in long texts count as junk, as by default."""
    return difflib.SequenceMatcher(None, a, b).get_opcodes()


def unified(a: str, b: str, context: int = 2, most: int | None = None) -> str:
    """A unified diff; beyond ``most`` lines its middle is left out."""
    out = list(difflib.unified_diff(a.splitlines(), b.splitlines(), "a", "b", lineterm="", n=context))
    if most and len(out) > most:
        head = most // 2
        out = [*out[:head], f"... <{len(out) - most} diff lines left out> ...", *out[len(out) - (most - head) :]]
    return "\n".join(out)


def tells(line: str) -> bool:
    s = line.strip()
    return len(s) > 3 and not _NOISE.match(s) and not re.search("existing code|more code", s, re.I)


def expected_edits(a: list[str], b: list[str]) -> list[dict]:
    """D3: the edits from original to truth, with up to five telling new lines as their signature."""
    out = []
    for tag, i1, i2, j1, j2 in opcodes(a, b):
        if tag != "equal":
            new = b[j1:j2]
            out.append({"id": len(out), "tag": tag, "start": i1, "end": i2, "old": a[i1:i2], "new": new, "signature": list(dict.fromkeys(x.strip() for x in new if tells(x)))[:5]})
    return out


def merge_windows(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching windows as one."""
    out: list[list[int]] = []
    for s, e in sorted(windows):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def touches(i1: int, i2: int, windows: list[tuple[int, int]]) -> bool:
    """A point lies in a window with both its ends, a range overlaps it half-open."""
    return any(s <= i1 <= e if i1 == i2 else i1 < e and i2 > s for s, e in windows)


def moved_to(codes: list[tuple], line: int) -> int:
    """About where a line of the original stands in the prediction."""
    at = 0
    for tag, i1, i2, j1, j2 in codes:
        if line < i1:
            break
        if i1 <= line < i2:
            return j1 + line - i1 if tag == "equal" else j1
        if tag == "insert" and line == i2:
            return j2
        at = j2
    return at


def coverage(want: list[str], have: list[str]) -> float:
    """The share of the wanted lines in matching blocks."""
    if not want:
        return 1.0
    return sum(m.size for m in difflib.SequenceMatcher(None, want, have).get_matching_blocks()) / len(want)


def summary(original: str, truth: str, prediction: str) -> dict:
    """How a prediction relates to the edits that were wanted."""
    a, b, p = original.splitlines(), truth.splitlines(), prediction.splitlines()
    edits = expected_edits(a, b)
    windows = merge_windows([(max(0, e["start"] - BUFFER), min(len(a), e["end"] + BUFFER)) for e in edits])
    matcher = difflib.SequenceMatcher(None, a, p)
    codes = matcher.get_opcodes()
    changed = [c for c in codes if c[0] != "equal"]
    inside = sum(touches(c[1], c[2], windows) for c in changed)
    missing, near, misplaced = [], [], []
    weighted = total = 0.0
    for e in edits:
        anchor = moved_to(codes, e["start"])
        window = p[max(0, anchor - REACH) : min(len(p), anchor + REACH)]
        n, local = len(e["new"]), coverage(e["new"], window)
        weighted += local * n
        total += n
        if n and local < 0.2:
            check = [x for x in e["new"] if tells(x)] or [x for x in e["new"] if x.strip()]
            bare = {x.strip() for x in window}
            if check and sum(x.strip() in bare for x in check) >= 0.8 * len(check):
                near.append(e["id"])
        if n and e["id"] not in near and coverage(e["new"], p) < 0.2:
            missing.append(e["id"])
        marks = set(e["signature"])
        spots = [i for i, x in enumerate(p) if x.strip() in marks][:SPOTS] if marks else []
        # within reach is near; beyond it, from FAR lines on, the edit is in the wrong place
        if spots and min(abs(i - anchor) for i in spots) > REACH:
            misplaced.append(e["id"])
    edit = lambda e: {"id": e["id"], "tag": e["tag"], "start": e["start"], "end": e["end"], "signature": e["signature"][:3], "old": e["old"][:5], "new": e["new"][:5]}
    strays = [c for c in changed if not touches(c[1], c[2], windows)]
    return {
        "no_op_score": matcher.ratio() if a or p else 1.0, "patch_match_score": weighted / total if total else 1.0, "expected_edit_count": len(edits), "actual_edit_count": len(changed),
        "side_effect_opcode_count": len(changed) - inside, "patch_area_opcode_count": inside, "missing": missing, "near_miss": near, "misplaced": misplaced, "windows": windows,
        "expected_edits": [edit(e) for e in edits[:SHOWN_EDITS]], "side_effects": [dict(zip(("tag", "i1", "i2", "j1", "j2"), c)) for c in strays[:SHOWN_STRAYS]],
    }


def line_errors(snippet: str | None, truth: str, prediction: str) -> tuple[int, int]:
    """Wrong lines inside the snippet and outside; replaced and deleted lines count by the truth, inserted ones by the prediction."""
    rows = lambda s: [x.strip() for x in s.strip().splitlines()]
    a, b = rows(truth), rows(prediction)
    inner = set(rows(snippet)) if snippet else set()
    patch = side = 0
    for tag, i1, i2, j1, j2 in opcodes(a, b):
        for x in (() if tag == "equal" else b[j1:j2] if tag == "insert" else a[i1:i2]):
            if x:
                patch, side = (patch + 1, side) if x in inner else (patch, side + 1)
    return patch, side


_D, _I, _IDS = DoubleType(), IntegerType(), ArrayType(IntegerType())
FEATURES = StructType(
    [StructField(c, _D) for c in ("no_op_score", "patch_match_score")]
    + [StructField(c, _I) for c in ("expected_edit_count", "actual_edit_count", "side_effect_opcode_count", "patch_area_opcode_count")]
    + [StructField(c, _IDS) for c in ("missing", "near_miss", "misplaced")]
    + [StructField("windows", ArrayType(StructType([StructField("start", _I), StructField("end", _I)])))]
    + [StructField("expected_edits", ArrayType(StructType([StructField("id", _I), StructField("tag", StringType()), StructField("start", _I), StructField("end", _I), *(StructField(c, ArrayType(StringType())) for c in ("signature", "old", "new"))])))]
    + [StructField("side_effects", ArrayType(StructType([StructField("tag", StringType()), *(StructField(c, _I) for c in ("i1", "i2", "j1", "j2"))])))]
)


@F.pandas_udf(FEATURES)
def diff_features(original: pd.Series, truth: pd.Series, prediction: pd.Series) -> pd.DataFrame:
    """A struct of features per row; nulls count as empty texts."""
    rows = [summary(a or "", b or "", p or "") for a, b, p in zip(original, truth, prediction)]
    frame = pd.DataFrame(rows, columns=FEATURES.names)
    frame["windows"] = [[{"start": s, "end": e} for s, e in w] for w in frame["windows"]]
    return frame


def compact(f: Column) -> Column:
    """The figures of :func:`diff_features` for a judge's prompt, with five edits and ten strays."""
    names = ("no_op_score", "patch_match_score", "expected_edit_count", "actual_edit_count", "side_effect_opcode_count", "patch_area_opcode_count")
    ids = {"missing_expected_edit_ids": "missing", "near_miss_expected_edit_ids": "near_miss", "misplaced_expected_edit_ids": "misplaced"}
    return F.struct(*[f[c].alias(c) for c in names], *[f[c].alias(k) for k, c in ids.items()], F.slice(f["expected_edits"], 1, 5).alias("expected_edits_preview"), F.slice(f["side_effects"], 1, 10).alias("side_effect_opcodes_preview"))


@F.pandas_udf(StructType([StructField("patch", _I), StructField("side", _I)]))
def line_error_counts(snippet: pd.Series, truth: pd.Series, prediction: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([line_errors(s, a or "", p or "") for s, a, p in zip(snippet, truth, prediction)], columns=["patch", "side"])


@F.pandas_udf(StringType())
def unified_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([unified(x or "", y or "") for x, y in zip(a, b)], dtype=object)


def dense_score(equal: Column, patch: Column, side: Column, split: Column) -> Column:
    """1 for an equal file, 0 in the test split, else less for each wrong line, down to 0."""
    return F.when(equal >= 1.0, 1.0).when(split == "test", 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - PATCH_PENALTY * patch - SIDE_PENALTY * side))

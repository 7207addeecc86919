"""Queries that need Python: equivalence by language, differences, patches and streams."""

from __future__ import annotations

import json
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from ..functions import compare as E
from ..functions import diffs as D
from ..functions import patches as P
from ..functions import text as T
from ..operators import classify as C
from ..runtime import spread, stored, table
from . import sql as S


def _apply(spark, d, *columns):
    return spread(table(spark, d, "apply_samples").select("sample_id", *columns))


def language_score(spark, d):
    """The score of each prediction by the comparison of its language."""
    return E.score(_apply(spark, d, "prediction_raw", "ground_truth", "language"), "prediction_raw", "ground_truth", "language").select("sample_id", "score")


def language_accuracy(spark, d):
    """A1 over E10."""
    df = E.score(_apply(spark, d, "prediction_raw", "ground_truth", "language"), "prediction_raw", "ground_truth", "language")
    return df.groupBy(T.report_language("language").alias("language")).agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("score"), 6).alias("accuracy"))


def _by_language(name: str):
    def run(spark, d):
        df = _apply(spark, d, "prediction_raw", "ground_truth", "language").where(T.language("language") == name)
        return E.score(df, "prediction_raw", "ground_truth", "language").select("sample_id", "score")

    return run


def reflexive(spark, d):
    """Every file equals itself with other line ends, and never itself with a foreign line: scores that SQL alone must give."""
    df = _apply(spark, d, "ground_truth", "language").where(F.col("ground_truth").isNotNull())
    df = df.withColumn("same", P.wrap(F.regexp_replace(T.newlines("ground_truth"), "\n", "\r\n"))).withColumn("more", P.wrap(F.concat("ground_truth", F.lit("\nQZ_MORE ~~ one\n"))))
    out = E.score(E.score(df, "same", "ground_truth", "language"), "more", "ground_truth", "language", name="with_more")
    return out.select("sample_id", "score", "with_more")


def diff_features(spark, d):
    """Features of the samples whose prediction differs from the truth."""
    df = _apply(spark, d, "original_code", "ground_truth", "prediction_raw").withColumn("p", T.wrapper_strip("prediction_raw"))
    wrong = df.where(~F.coalesce(T.text_form("p") == T.text_form("ground_truth"), F.lit(False)))
    out = wrong.select("sample_id", D.diff_features("original_code", "ground_truth", "p").alias("f"))
    return out.select("sample_id", *[F.round(f"f.{c}", 6).alias(c) for c in ("no_op_score", "patch_match_score")], "f.expected_edit_count", "f.actual_edit_count", "f.side_effect_opcode_count", "f.patch_area_opcode_count", F.size("f.missing").alias("missing"), F.size("f.near_miss").alias("near_miss"), F.size("f.misplaced").alias("misplaced"))


@F.pandas_udf(BooleanType())
def _parses(text: pd.Series, language: pd.Series) -> pd.Series:
    def ok(t: str | None, g: str | None) -> bool:
        if not (t or "").strip():
            return g is None
        if g not in ("json", "yaml", "xml", "ini"):
            return True
        try:
            if g == "json":
                json.loads(t)
            elif g == "xml":
                E.ET.fromstring(t.strip())
            elif g == "ini":
                E.configparser.ConfigParser().read_string(t)
            elif E.yaml is not None:
                list(E.yaml.safe_load_all(t))
            return True
        except Exception:
            return False

    return pd.Series([ok(t, g) for t, g in zip(text, language)], dtype=bool)


def classify_errors(spark, d):
    """The class of each wrong prediction: the gate in SQL, parsing of data formats and the rules over features."""
    df = _apply(spark, d, "original_code", "ground_truth", "prediction_raw", "language").withColumn("p", T.wrapper_parse("prediction_raw")["content"])
    scored = E.score(df, "prediction_raw", "ground_truth", "language").where(F.col("score") < 1)
    gated = scored.withColumn("invalid", (F.size(C.gate("prediction_raw")) > 0) | ~_parses("p", T.language("language")))
    # both branches below read the wrong rows: they are scored once
    gated = stored(gated.select("sample_id", "invalid", "original_code", "ground_truth", "p"), "wrong")
    bad = gated.where("invalid").select("sample_id", F.lit("OUTPUT_INVALID").alias("error_type"), F.lit(1.0).alias("confidence"))
    f = gated.where(~F.col("invalid")).select("sample_id", (T.newlines("original_code") != T.newlines("ground_truth")).alias("expected"), D.diff_features("original_code", "ground_truth", "p").alias("f"))
    cols = {c: F.col(f"f.{c}") for c in ("no_op_score", "patch_match_score", "actual_edit_count", "side_effect_opcode_count")} | {c: F.size(f"f.{c}") for c in ("missing", "misplaced")}
    ruled = f.select("sample_id", C.rule(cols, F.coalesce("expected", F.lit(False))).alias("r")).select("sample_id", "r.error_type", "r.confidence")
    return bad.union(ruled)


def dense_score(spark, d):
    """The graded score of each prediction."""
    df = _apply(spark, d, "ground_truth", "prediction_raw", "update_snippet", "language").withColumn("p", T.wrapper_strip("prediction_raw"))
    scored = E.score(df, "prediction_raw", "ground_truth", "language")
    same = scored.where(F.col("score") >= 1).select("sample_id", F.lit(1.0).alias("dense"))
    rest = scored.where(F.col("score") < 1).select("sample_id", D.line_error_counts("update_snippet", "ground_truth", "p").alias("e"))
    return same.union(rest.select("sample_id", F.round(D.dense_score(F.lit(0.0), F.col("e.patch"), F.col("e.side"), F.lit("train")), 6)))


def block_edits(a: str, b: str) -> list[dict]:
    """The edits that turn ``a`` into ``b``, in turn: blocks with two lines of context, more where the block would not be unique."""
    x, y, out = a.split("\n"), b.split("\n"), []
    for group in SequenceMatcher(None, x, y).get_grouped_opcodes(2):
        i, j, stop = group[0][1], group[0][3], group[-1][4]
        now = y[:j] + x[i:]  # the file after the edits before this one
        text, end, wider = "\n".join(now), j + group[-1][2] - i, 1
        before, behind = j, end
        while (not (old := "\n".join(now[before:behind])) or text.find(old) != text.rfind(old)) and behind - before < len(now):
            before, behind, wider = max(0, before - wider), min(len(now), behind + wider), 2 * wider
        out.append({"oldString": old, "newString": "\n".join(now[before:j] + y[j:stop] + now[end:behind]), "replaceAll": False})
    return out


@F.pandas_udf(StringType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """The edits between two texts as a patch."""
    return pd.Series([json.dumps({"edits": block_edits(x or "", y or "") if x != y else []}) for x, y in zip(a, b)])


def sar_apply(spark, d):
    """H1-H3: the truth rebuilt from the original by a search-and-replace patch."""
    df = _apply(spark, d, "original_code", "ground_truth").where(F.col("original_code").isNotNull() & F.col("ground_truth").isNotNull() & (F.col("original_code") != ""))
    out = df.select("sample_id", "ground_truth", P.sar_apply(T.newlines("original_code"), _edits(T.newlines("original_code"), T.newlines("ground_truth"))).alias("r"))
    return out.select("sample_id", (T.newlines("ground_truth") == F.col("r.result")).alias("rebuilt"), "r.error")


def udiff_apply(spark, d):
    """The truth rebuilt from the original by the unified difference of both."""
    df = _apply(spark, d, "original_code", "ground_truth").where(F.col("original_code").isNotNull() & F.col("ground_truth").isNotNull())
    df = df.select("sample_id", T.newlines("original_code").alias("a"), T.newlines("ground_truth").alias("b")).where((F.col("a") != F.col("b")) & F.trim("a").rlike(r"\S"))
    out = df.select("sample_id", "b", P.udiff_apply("a", D.unified_diff("a", "b")).alias("r"))
    return out.select("sample_id", (F.regexp_replace("b", r"\n+\z", "") == F.regexp_replace("r.result", r"\n+\z", "")).alias("rebuilt"), "r.error")


def unified_diff(spark, d):
    """Hunks and changed lines of the difference between original and truth."""
    df = _apply(spark, d, "original_code", "ground_truth").where(F.col("original_code").isNotNull() & F.col("ground_truth").isNotNull())
    u = df.select("sample_id", D.unified_diff("original_code", "ground_truth").alias("u"))
    count = lambda r: F.regexp_count("u", F.lit(r))
    return u.select("sample_id", count(r"(?m)^@@ ").alias("hunks"), count(r"(?m)^\+(?!\+\+ )").alias("added"), count(r"(?m)^-(?!-- )").alias("removed"))


QUERIES = {
    "language_score": (language_score, None),
    "language_accuracy": (language_accuracy, None),
    **{f"{n.replace('+', 'p')}_equiv": (_by_language(n), None) for n in ("json", "yaml", "xml", "ini", "python")},
    "reflexive": (reflexive, "SELECT sample_id, CAST(1 AS DOUBLE) AS score, CAST(0 AS DOUBLE) AS with_more FROM apply_samples WHERE ground_truth IS NOT NULL"),
    "diff_features": (diff_features, None),
    "classify_errors": (classify_errors, None),
    "dense_score": (dense_score, None),
    "sar_apply": (sar_apply, "SELECT sample_id, true AS rebuilt, CAST(NULL AS VARCHAR) AS error FROM apply_samples WHERE original_code <> '' AND ground_truth IS NOT NULL"),
    "udiff_apply": (udiff_apply, f"SELECT sample_id, true AS rebuilt, CAST(NULL AS VARCHAR) AS error FROM apply_samples WHERE {S.nl('original_code')} <> {S.nl('ground_truth')} AND regexp_matches(original_code, '\\S')"),
    "unified_diff": (unified_diff, None),
}

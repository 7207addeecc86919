"""The validity gate, the six error classes, judges' replies and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: The error classes.
ERRORS = ("OUTPUT_INVALID", "PATCH_NOT_APPLIED", "PATCH_INCOMPLETE", "PATCH_INCORRECT", "WRONG_POSITION", "OUT_OF_PATCH_SIDE_EFFECT")
VERDICTS = ("correct", "incorrect", "needs_review")


#: What each class means, for judges and reports.
MEANING = {
    "OUTPUT_INVALID": "the answer is no complete file: wrapper missing, text around it, placeholders left in it, or it does not parse",
    "PATCH_NOT_APPLIED": "the answer is the original, or all but the same",
    "PATCH_INCOMPLETE": "some of the wanted edits are missing",
    "PATCH_INCORRECT": "the wanted place was edited, but not as wanted",
    "WRONG_POSITION": "a wanted edit stands in another place",
    "OUT_OF_PATCH_SIDE_EFFECT": "lines that no wanted edit covers were changed",
}


def error_types(spark: SparkSession, rubric: bool = False) -> DataFrame:
    """The classes as a table, with their meaning on demand."""
    return spark.createDataFrame([(e, MEANING[e]) for e in ERRORS], "error_type string, meaning string") if rubric else spark.createDataFrame([(e,) for e in ERRORS], "error_type string")


def error_reply(reply: Column | str) -> Column:
    """C11: struct(error_type, confidence, reason_brief, error) of a judge's JSON reply on the class of an error.

    The type must be one of the six as written; the confidence is clamped to 0 to 1,
    0.5 where it is none; of the reasons three of 300 characters are kept.
    """
    v = T.json_object(reply)
    kind = F.try_variant_get(v, "$.error_type", "string")
    text = F.coalesce(F.col(reply) if isinstance(reply, str) else reply, F.lit(""))
    error = F.when(text == "", "empty_llm_response").when(v.isNull(), "llm_json_parse_failed").when(kind.isNull() | ~kind.isin(*ERRORS), F.concat(F.lit("llm_invalid_error_type: "), F.coalesce(kind, F.lit("None"))))
    reasons = F.transform(F.slice(F.coalesce(F.try_variant_get(v, "$.reason_brief", "array<string>"), F.array().cast("array<string>")), 1, 3), lambda x: F.left(x, F.lit(300)))
    good = error.isNull()
    confidence = T.confidence(F.try_variant_get(v, "$.confidence", "string"))
    return F.struct(F.when(good, kind).alias("error_type"), F.when(good, confidence).alias("confidence"), F.when(good, reasons).alias("reason_brief"), error.alias("error"))


def gate(raw: Column | str) -> Column:
    """Why an output is no valid file, in order; parsing by format is added by the caller."""
    p = T.wrapper_parse(raw)
    lost = T.placeholders(p["content"])
    reasons = [
        F.when(~p["has_start"] | ~p["has_end"], "wrapper_missing_or_truncated"), F.when((p["opens"] != 1) | (p["closes"] != 1), "wrapper_count_abnormal"),
        F.when(p["outside"] != "", "extra_text_outside_wrapper"), F.when(F.size(lost) > 0, "placeholder_leakage"),
    ]
    return F.concat(F.array_compact(F.array(*reasons)), F.transform(F.slice(lost, 1, 3), lambda x: F.concat(F.lit("placeholder: "), x)))


def rule(f: dict[str, Column], expected: Column) -> Column:
    """struct(error_type, confidence, deterministic) from features of the difference; ``expected``: an edit was wanted."""
    sure = lambda e, c: F.struct(F.lit(e).alias("error_type"), F.lit(c).alias("confidence"), F.lit(c >= 0.9).alias("deterministic"))
    return (
        F.when(~expected, sure("OUT_OF_PATCH_SIDE_EFFECT", 0.99)).when((f["actual_edit_count"] == 0) & (f["no_op_score"] >= 0.9995), sure("PATCH_NOT_APPLIED", 0.99))
        .when((f["patch_match_score"] >= 0.99) & (f["side_effect_opcode_count"] > 0), sure("OUT_OF_PATCH_SIDE_EFFECT", 0.92)).when(f["misplaced"] > 0, sure("WRONG_POSITION", 0.6))
        .when(f["missing"] > 0, sure("PATCH_INCOMPLETE", 0.55)).otherwise(sure("PATCH_INCORRECT", 0.55))
    )


def guard(claimed: Column, f: dict[str, Column], expected: Column) -> Column:
    """struct(error_type, needs_review, reason): a judge's class against the features."""
    out = lambda e, review, why: F.struct(e.alias("error_type"), F.lit(review).alias("needs_review"), F.lit(why).cast("string").alias("reason"))
    side, absent = F.lit("OUT_OF_PATCH_SIDE_EFFECT"), claimed == "PATCH_NOT_APPLIED"
    return (
        F.when(~expected & (claimed != side), out(side, True, "no edit was expected")).when((claimed == side) & (f["side_effect_opcode_count"] == 0), out(claimed, True, "no edit outside the patch"))
        .when(absent & (f["side_effect_opcode_count"] > 0), out(claimed, True, "edits outside the patch")).when(absent & (f["no_op_score"] < 0.98) & (f["patch_match_score"] > 0.3), out(claimed, True, "the patch seems applied"))
        .when((claimed == "WRONG_POSITION") & (f["misplaced"] == 0), out(claimed, True, "no misplaced edit")).otherwise(out(claimed, False, None))
    )


def merged(by_rule: Column, claimed: Column, guarded: Column, least: float = 0.9) -> Column:
    """The rule where it is sure or no judge spoke, else the guarded class."""
    skip = by_rule["deterministic"] & (by_rule["confidence"] >= least)
    use = ~skip & claimed.isin(*ERRORS)
    return F.struct(
        F.when(use, guarded["error_type"]).otherwise(by_rule["error_type"]).alias("error_type"),
        F.when(use, guarded["needs_review"]).otherwise(~skip).alias("needs_review"), F.coalesce(use, F.lit(False)).alias("used_judge"),
    )


def judge_reply(reply: Column | str) -> Column:
    """struct(verdict, confidence, reason, error) of a judge's JSON reply."""
    v = T.json_object(reply)
    get = lambda k, t="string": F.try_variant_get(v, f"$.{k}", t)
    verdict = F.lower(F.trim(get("verdict")))
    points = F.slice(F.coalesce(F.try_variant_get(v, "$.key_points", "array<string>"), F.array().cast("array<string>")), 1, 3)
    reason = F.left(F.coalesce(F.nullif(F.trim(get("reason")), F.lit("")), F.nullif(F.array_join(points, "; "), F.lit(""))), F.lit(1000))
    error = F.when(v.isNull(), "judge_json_parse_failed").when(verdict.isNull() | ~verdict.isin(*VERDICTS), F.concat(F.lit("invalid_verdict: "), F.coalesce(verdict, F.lit("")))).when(reason.isNull(), "missing_reason")
    return F.struct(F.when(error.isNull(), verdict).alias("verdict"), T.confidence(get("confidence")).alias("confidence"), reason.alias("reason"), error.alias("error"))


def fallback(missing: Column, invalid: Column, score: Column, dry: bool = False) -> Column:
    """struct(verdict, confidence) where no judge decides."""
    d = lambda v, c: F.struct(F.lit(v).alias("verdict"), F.lit(c).alias("confidence"))
    return F.when(missing, d("needs_review", 0.0)).when(invalid, d("incorrect", 1.0)).when(score >= 1.0, d("correct", 0.8 if dry else 0.95)).otherwise(d("needs_review", 0.0 if dry else 0.2))

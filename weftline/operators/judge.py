"""A judge's decision on each prediction, with the evidence it was given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compare as E
from ..functions import diffs as D
from ..functions import text as T
from . import classify as C

NEEDED = ("original_code", "update_snippet", "ground_truth", "prediction_raw")
SHOWN = 5  # reasons that a record lists
#: The reasons of decisions without a judge.
MISSING = "Missing required fields for judging: "
INVALID = "Prediction is not a valid full-file apply output: "
EXACT = "Fallback accepted the prediction because rule_score=1.0 after stripping <update_file>."
DRY = "Dry-run mode: LLM call skipped, so this sample is marked needs_review unless deterministic fallback applies."
SILENT = "LLM judgment unavailable."


def evidence(df: DataFrame, invalid: Column | None = None) -> DataFrame:
    """``df`` with ``rule_score``, ``missing_fields``, ``output_invalid_reasons``, ``prediction``, three differences and ``signals``.

    ``df`` has the fields of ``NEEDED``, ``language``, ``source_file`` and ``line_no``;
    ``invalid`` adds reasons (an array) to those of the gate, such as a failed parse.
    Nulls count as empty texts and are listed as missing.
    """
    p = T.wrapper_parse("prediction_raw")
    missing = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(c)) for c in NEEDED]))
    reasons = C.gate("prediction_raw") if invalid is None else F.concat(C.gate("prediction_raw"), invalid)
    out = E.score(df, "prediction_raw", "ground_truth", "language", name="rule_score")
    out = out.withColumns({"missing_fields": missing, "output_invalid_reasons": reasons, "prediction": F.coalesce(p["content"], F.lit(""))})
    out = out.withColumn("features", D.diff_features("original_code", "ground_truth", "prediction"))
    for name, a, b in (("expected_diff", "original_code", "ground_truth"), ("actual_diff", "original_code", "prediction"), ("prediction_vs_ground_truth_diff", "ground_truth", "prediction")):
        out = out.withColumn(name, D.unified_diff(a, b))
    wrapper = F.struct(p["has_start"].alias("has_start_tag"), p["has_end"].alias("has_end_tag"), p["opens"].alias("start_tag_count"), p["closes"].alias("end_tag_count"), (p["outside"] != "").alias("outside_text_nonempty"))
    length = lambda c: F.length(F.coalesce(c, F.lit("")))
    signals = F.struct(
        "rule_score", (F.size("output_invalid_reasons") > 0).alias("output_invalid"), F.slice("output_invalid_reasons", 1, SHOWN).alias("output_invalid_reasons"), wrapper.alias("prediction_wrapper"), "missing_fields",
        length("original_code").alias("original_code_length"), length("ground_truth").alias("ground_truth_length"), length("prediction").alias("prediction_extracted_length"), D.compact(F.col("features")).alias("feature_summary"),
    )
    return out.withColumn("signals", signals)


def records(df: DataFrame, reply: str | None = None, model: str = "none", elapsed: Column | None = None, dry: bool = False, invalid: Column | None = None) -> DataFrame:
    """The 17 columns of a judged prediction beside those of ``df``.

    ``reply`` names the column with the judge's answer; rows with missing fields are
    not sent to the judge, and where it doesn't answer, or not in the right form, the
    fallback decides. A dry run asks no judge.
    """
    e = evidence(df, invalid)
    asked = (F.size("missing_fields") == 0) & F.lit(reply is not None and not dry)
    said = C.judge_reply(F.col(reply) if reply else F.lit(None).cast("string"))
    bad = F.size("output_invalid_reasons") > 0
    fall = C.fallback(F.size("missing_fields") > 0, bad, F.col("rule_score"), dry)
    v = T.json_object(F.col(reply) if reply else F.lit(None).cast("string"))
    e = e.withColumns({"_asked": asked, "_said": said}).withColumn("_use", F.col("_asked") & F.col("_said.error").isNull())
    error = F.when(F.col("_asked"), F.when(F.col(reply).isNull(), "empty_llm_response").otherwise(F.col("_said.error"))) if reply else F.lit(None).cast("string")
    # the fallback's reason, points and flags, in the order of its decisions
    first = F.slice("output_invalid_reasons", 1, 3)
    unsent = F.lit(DRY) if dry else F.coalesce(error, F.lit(SILENT))
    lost, exact = F.size("missing_fields") > 0, F.col("rule_score") >= 1.0
    why = F.when(lost, F.concat(F.lit(MISSING), F.array_join("missing_fields", ", "))).when(bad, F.concat(F.lit(INVALID), F.array_join(first, "; "))).when(exact, F.lit(EXACT)).otherwise(unsent)
    hints = F.when(~lost & bad, first).otherwise(F.array(F.left(why, F.lit(300))))
    matches = F.when(lost, F.lit(None)).when(bad, F.lit(False)).when(exact, F.lit(True)).cast("boolean")
    applied = F.when(~lost & ~bad & exact, F.lit(True)).cast("boolean")
    points = F.slice(F.coalesce(F.try_variant_get(v, "$.key_points", "array<string>"), F.array().cast("array<string>")), 1, SHOWN)
    flag = lambda key, other: F.when(F.col("_use"), F.try_variant_get(v, f"$.{key}", "boolean")).otherwise(other)
    fields = F.create_map(*[x for c in (*NEEDED, "language") if c in df.columns for x in (F.lit(c), F.lit(c))])
    return e.select(
        *df.columns, F.col("source_file").alias("judge_input_file"), F.col("line_no").alias("judge_input_line"), F.when(F.col("_use"), F.col("_said.verdict")).otherwise(fall["verdict"]).alias("judge_result"),
        F.when(F.col("_use"), F.col("_said.confidence")).otherwise(fall["confidence"]).alias("judge_confidence"), F.when(F.col("_use"), F.col("_said.reason")).otherwise(why).alias("judge_reason"),
        F.when(F.col("_use"), points).otherwise(hints).alias("judge_key_points"), flag("matches_ground_truth", matches).alias("judge_matches_ground_truth"), flag("requested_change_applied", applied).alias("judge_requested_change_applied"),
        F.lit(model).alias("judge_model"), (F.lit(0.0) if elapsed is None else F.round(elapsed, 6)).alias("judge_elapsed_time_s"), F.col("_asked").alias("judge_used_llm"), error.alias("judge_error"), bad.alias("judge_output_invalid"),
        F.slice("output_invalid_reasons", 1, SHOWN).alias("judge_output_invalid_reasons"), F.col("rule_score").alias("judge_rule_score"), F.to_json("signals").alias("judge_signals"), fields.alias("judge_extracted_field_names"),
    )

"""Queries over judge records, patches with every kind of flaw, and files written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import diffs as D
from ..functions import patches as P
from ..functions import text as T
from ..operators import classify as C
from ..operators import judge as J
from ..operators import records as R
from ..operators import reports as A
from ..operators import votes as V
from ..runtime import checkpoint_dir, spread, table
from ..sources import readers, sinks
from . import data_queries as Q
from . import sql as S


def _apply(spark, d, *columns):
    return spread(table(spark, d, "apply_samples").select("sample_id", *columns))


def judge_records(spark, d):
    """The 17 columns of each judged prediction, without a judge."""
    df = _apply(spark, d, "source_file", "line_no", "language", "original_code", "update_snippet", "ground_truth", "prediction_raw")
    return J.records(df).drop("original_code", "update_snippet", "ground_truth", "prediction_raw", "language", "source_file", "line_no")


def judge_missing(spark, d):
    """The records of samples with missing fields, which no judge sees."""
    out = judge_records(spark, d).where(F.col("judge_reason").startswith(J.MISSING))
    return out.select("sample_id", "judge_input_file", "judge_input_line", "judge_result", "judge_confidence", "judge_reason", "judge_model", "judge_used_llm", "judge_error", "judge_matches_ground_truth")


_LOST = "list_filter([" + ", ".join(f"CASE WHEN trim(coalesce({c}, '')) = '' THEN '{c}' END" for c in J.NEEDED) + "], lambda x: x IS NOT NULL)"


def compact_summary(spark, d):
    """Figures and previews of the difference of each wrong prediction."""
    df = _apply(spark, d, "original_code", "ground_truth", "prediction_raw").withColumn("p", T.wrapper_strip("prediction_raw"))
    out = df.select("sample_id", D.compact(D.diff_features("original_code", "ground_truth", "p")).alias("s"))
    return out.select("sample_id", "s.expected_edit_count", F.size("s.expected_edits_preview").alias("edits_shown"), F.size("s.side_effect_opcodes_preview").alias("strays_shown"), F.to_json("s").alias("summary"))


def votes_by_count(spark, d):
    """Samples by the number of models that fail them."""
    return V.by_votes(V.counts(Q._votes_in(spark, d)), len(Q.MODELS), shown=5, least=3).withColumn("shown", F.array_join("shown", ","))


#: Replies on the class of an error, and what becomes of them.
_CLASSES = (
    ('{"error_type": "WRONG_POSITION", "confidence": 0.8, "reason_brief": ["a", "b", "c", "d"]}', ("WRONG_POSITION", 0.8, "a|b|c", None)),
    ('Sure: {"error_type": "PATCH_INCOMPLETE", "confidence": "7"}', ("PATCH_INCOMPLETE", 1.0, "", None)),
    ('{"error_type": "PATCH_INCORRECT", "confidence": "high", "reason_brief": "no list"}', ("PATCH_INCORRECT", 0.5, "", None)),
    ('{"error_type": "patch_incorrect"}', (None, None, None, "llm_invalid_error_type: patch_incorrect")),
    ("no json", (None, None, None, "llm_json_parse_failed")), ("", (None, None, None, "empty_llm_response")), ('{"confidence": 1}', (None, None, None, "llm_invalid_error_type: None")),
)


def error_reply(spark, d):
    """C11: replies of all kinds, by sample."""
    reply = F.element_at(F.array(*[F.lit(r) for r, _ in _CLASSES]), (F.col("sample_id") % len(_CLASSES) + 1).cast("int"))
    out = _apply(spark, d).select("sample_id", C.error_reply(reply).alias("j"))
    return out.select("sample_id", "j.error_type", "j.confidence", F.array_join("j.reason_brief", "|").alias("reasons"), "j.error")


_CLASS_SQL = f"SELECT sample_id, v.error_type, CAST(v.confidence AS DOUBLE) AS confidence, v.reasons, v.error FROM apply_samples JOIN (VALUES {', '.join(f'({i}, {", ".join(map(Q._value, r))})' for i, (_, r) in enumerate(_CLASSES))}) v(k, error_type, confidence, reasons, error) ON v.k = sample_id % {len(_CLASSES)}"


def error_ratios_by_source(spark, d):
    """Counts and ratios of the final, the rule's and the judge's classes."""
    kinds = (*C.ERRORS, "CLASSIFIER_CRASH")
    pick = lambda k: F.element_at(F.array(*map(F.lit, kinds)), (F.pmod(F.col("sample_id") * k, F.lit(len(kinds))) + 1).cast("int"))
    rows = _apply(spark, d).select(F.explode(F.array(*[F.struct(F.lit(n).alias("source"), c.alias("error_type")) for n, c in (("final", pick(1)), ("rule", pick(3)), ("llm", F.when(F.col("sample_id") % 4 == 0, pick(5))))])).alias("r")).select("r.*")
    return A.error_ratios_by(rows, C.error_types(spark), ["final", "rule", "llm"])


_KINDS = "[" + ", ".join(f"'{k}'" for k in (*C.ERRORS, "CLASSIFIER_CRASH")) + "]"
_RATIOS_SQL = f"""
WITH r AS (
  SELECT 'final' AS source, ({_KINDS})[sample_id % 7 + 1] AS error_type FROM apply_samples UNION ALL SELECT 'rule', ({_KINDS})[sample_id * 3 % 7 + 1] FROM apply_samples
  UNION ALL SELECT 'llm', ({_KINDS})[sample_id * 5 % 7 + 1] FROM apply_samples WHERE sample_id % 4 = 0),
c AS (SELECT source, error_type, count(*) AS n FROM r GROUP BY 1, 2),
e AS (SELECT source, error_type FROM (VALUES ('final'), ('rule'), ('llm')) s(source), (SELECT unnest([{', '.join(f"'{k}'" for k in C.ERRORS)}]) AS error_type) UNION SELECT source, error_type FROM c)
SELECT source, error_type, coalesce(n, 0) AS n, round(coalesce(coalesce(n, 0) / CAST(nullif(sum(coalesce(n, 0)) OVER (PARTITION BY source), 0) AS DOUBLE), 0), 6) AS ratio FROM e LEFT JOIN c USING (source, error_type)
"""

#: Search-and-replace patches, one of each kind: (before the text, behind it, the patch, what the two become, error). The text itself is the sample's original.
_FLAWS = (
    ("alpha one\n", "\nomega", [("alpha one", "alpha 1", False)], "alpha 1\n", "\nomega", None),  # literal
    ("alpha one\n", "\nomega", [("alpha one", "alpha 1", False), ("alpha 1", "beta", False)], "beta\n", "\nomega", None),  # edits in turn
    ("twin ~ line\n", "\ntwin ~ line", [("twin ~ line", "x", False)], None, None, P.AMBIGUOUS),
    ("twin ~ line\n", "\ntwin ~ line", [("twin ~ line", "x ~ y", True)], "x ~ y\n", "\nx ~ y", None),  # every place
    ("    aa ~ 1\n      bb ~ 2\n", "", [("aa ~ 1\n  bb ~ 2", "    cc", False)], "    cc\n", "", None),  # other indentation
    ("begin ~ block\n  q ~ one\n  q ~ two\nend ~ block\n", "", [("begin ~ block\n  q ~ ONE\n  q ~ two\nend ~ block", "gone", False)], "gone\n", "", None),  # anchored by first and last line
    ("a ~  b\t~ c\n", "", [("a ~ b ~ c", "z", False)], "z\n", "", None),  # runs of blanks
    ("say ~ \"hi\"\tyou\n", "", [('say ~ \\"hi\\"\\tyou', "z", False)], "z\n", "", None),  # escapes
    ("alpha ~ one\n", "", [("\n  alpha ~ one  \n", "z", False)], "z\n", "", None),  # blanks at the ends
    ("", "", [("no such ~ text, nowhere", "z", False)], None, None, P.NOT_FOUND), ("alpha ~ one\n", "", [("alpha ~ one", "alpha ~ one", False)], None, None, P.NO_CHANGE),
    ("", "", "no json at all", None, None, P.NOT_JSON), ("", "", "[3]", None, None, "Patch item #1 is not an object: int"), ("", "", '[{"oldString": "x"}]', None, None, "Patch item #1 must contain oldString and newString."), ("", "", "7", None, None, "Unexpected patch JSON type: int"), ("", "", " ", None, None, "Empty model output"),
)


def _patch_text(patch) -> str:
    import json

    return patch if isinstance(patch, str) else "```json\n" + json.dumps([{"oldString": a, "newString": b, "replaceAll": c} for a, b, c in patch]) + "\n```"


def sar_flaws(spark, d):
    """H1-H3: patches of every kind on every sample, chosen by its id."""
    k = (F.col("sample_id") % len(_FLAWS) + 1).cast("int")
    of = lambda i: F.element_at(F.array(*[F.lit(_patch_text(f[i]) if i == 2 else f[i]) for f in _FLAWS]), k)
    df = _apply(spark, d, "original_code").where(F.col("original_code").isNotNull())
    base = F.regexp_replace(T.newlines("original_code"), "~", "-")
    out = df.select("sample_id", P.sar_apply(F.concat(of(0), base, of(1)), of(2)).alias("r"))
    return out.select("sample_id", F.md5("r.result").alias("result"), "r.error")


def _text(s: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if s is None else " || ".join(f"'{p.replace(chr(39), chr(39) * 2)}'" for p in s.split("\n")).replace("' || '", "' || chr(10) || '") if s else "''"


_FLAW_SQL = f"""
SELECT sample_id, md5(v.a || replace({S.nl('original_code')}, '~', '-') || v.b) AS result, v.error FROM apply_samples
JOIN (VALUES {', '.join(f'({i}, {_text(f[3])}, {_text(f[4])}, {_text(f[5])})' for i, f in enumerate(_FLAWS))}) v(k, a, b, error) ON v.k = sample_id % {len(_FLAWS)} WHERE original_code IS NOT NULL
"""


def udiff_flaws(spark, d):
    """H4, H5: unified differences that fit, that have drifted, whose place is not unique, and that don't fit, by sample."""
    df = _apply(spark, d, "original_code").where(F.col("original_code").isNotNull())
    base = F.regexp_replace(T.newlines("original_code"), "~", "-")
    fit = F.lit("--- a\n+++ b\n@@ -1,2 +1,2 @@\n first ~ line\n-second ~ line\n+2nd ~ line\n")
    k = F.col("sample_id") % 5
    text = F.when(k == 1, F.concat(F.lit("moved\n" * 7 + "first ~ line\nsecond ~ line\n"), base)).when(k == 2, F.concat(F.lit("x\nfirst ~ line\nsecond ~ line\nfirst ~ line\nsecond ~ line\n"), base)).when(k == 3, F.concat(F.lit("other\n"), base)).otherwise(F.concat(F.lit("first ~ line\nsecond ~ line\n"), base))
    patch = F.when(k == 4, F.concat(F.lit("diff --git a b\n"), fit, F.lit("diff --git c d\n"), fit)).otherwise(fit)
    out = df.select("sample_id", P.udiff_apply(text, patch).alias("r"))
    return out.select("sample_id", F.md5("r.result").alias("result"), "r.error")


_BASE = f"replace({S.nl('original_code')}, '~', '-')"
_FAILS = "Hunk failed to apply (no unique match). Hint line=1, hunk_header=-1,2 +1,2"
_DRIFT_SQL = f"""
SELECT sample_id, md5(CASE sample_id % 5 WHEN 0 THEN 'first ~ line' || chr(10) || '2nd ~ line' || chr(10) || {_BASE} WHEN 1 THEN repeat('moved' || chr(10), 7) || 'first ~ line' || chr(10) || '2nd ~ line' || chr(10) || {_BASE} END) AS result,
  CASE sample_id % 5 WHEN 2 THEN '{_FAILS}' WHEN 3 THEN '{_FAILS}' WHEN 4 THEN 'Expected single-file patch, got multiple diff --git sections' END AS error
FROM apply_samples WHERE original_code IS NOT NULL
"""


def language_cells(spark, d):
    """Languages with the number of samples of three labels, of which one has fewer."""
    rows = _apply(spark, d, "language").select(T.report_language("language").alias("language"), F.explode(F.array(*[F.struct(F.lit(m).alias("label"), keep.alias("keep")) for m, keep in (("b", F.lit(True)), ("a", F.col("sample_id") % 50 != 0), ("none", F.lit(True)))])).alias("x")).select("language", "x.*").where("keep")
    return A.language_cells(rows.groupBy("language", "label").agg(F.count(F.lit(1)).alias("n")), ["b", "a"])


_CELL_SQL = f"""
WITH c AS (SELECT language, count(*) AS b, count(*) FILTER (sample_id % 50 <> 0) AS a FROM (SELECT sample_id, {S.report_lang('language')} AS language FROM apply_samples) GROUP BY 1)
SELECT language, CASE WHEN a = b OR a = 0 THEN language || ' (' || b || ')' ELSE language || ' (b:' || b || ', a:' || a || ')' END AS cell FROM c
"""


def run_summary(spark, d):
    """Answers and seconds of a run; the seconds come from the ids."""
    return A.run_summary(_apply(spark, d, "prediction_raw"), F.col("prediction_raw"), (F.col("sample_id") % 16) / 8.0)


def field_fallbacks(spark, d):
    """Language and truth of training rows, from the row itself or its structures."""
    rows = table(spark, d, "training_rows").withColumn("language", F.when(F.col("row_id") % 3 == 0, " ").when(F.col("row_id") % 3 == 1, "own")).withColumn("final", F.when(F.col("row_id") % 2 == 0, F.lit("")))
    return rows.select("row_id", R.language_or_extra(F.col("language"), F.col("extra_info.language")).alias("language"), F.length(R.truth_or_reward(F.col("final"), F.col("reward_model.ground_truth"))).alias("truth_chars"))


def _place(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/weftline-files-{uuid.uuid4().hex}"


def jsonl_strict(spark, d):
    """Samples written as JSON lines and read again with their faults."""
    place = _place(spark)
    table(spark, d, "apply_samples").select("sample_id", "language", "original_code").write.json(place)
    return readers.strict_jsonl(spark, place, "sample_id long, language string, original_code string").select("sample_id", "language", F.length("original_code").alias("n"), "error")


def jsonl_faults(spark, d):
    """Every seventh line is cut; strict reading gives it as a row, and a union leaves the file out."""
    place = _place(spark)
    line = F.to_json(F.struct("sample_id", "language"))
    rows = table(spark, d, "apply_samples").select(F.when(F.col("sample_id") % 7 == 0, F.left(line, F.lit(9))).otherwise(line).alias("value"))
    rows.write.text(f"{place}/bad.jsonl")
    table(spark, d, "apply_samples").select("sample_id").write.json(f"{place}/good.jsonl")
    both, errors = readers.load_all(spark, [f"{place}/bad.jsonl", f"{place}/good.jsonl"], "sample_id long")
    read = readers.strict_jsonl(spark, f"{place}/bad.jsonl", "sample_id long, language string")
    counted = read.agg(F.count("sample_id").alias("good"), F.count("error").alias("bad"))
    return counted.withColumn("united", F.lit(both.where(F.col("sample_id").isNotNull()).count())).withColumn("left_out", F.lit(len(errors)))


def sample_load(spark, d):
    """Training rows as flat samples, read from Parquet."""
    out = readers.samples(spark, f"{d}/training_rows.parquet")
    return out.select("index", "language", F.length("original_code").alias("n"), F.md5("ground_truth").alias("truth"))


def parquet_by_language(spark, d):
    """Samples written by language and read again."""
    place = _place(spark)
    sinks.by_language(table(spark, d, "apply_samples").select("sample_id", T.report_language("language").alias("language")), place)
    return spark.read.parquet(place).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "judge_records": (judge_records, None),
    "judge_missing": (judge_missing, f"SELECT sample_id, source_file AS judge_input_file, line_no AS judge_input_line, 'needs_review' AS judge_result, CAST(0 AS DOUBLE) AS judge_confidence, '{J.MISSING}' || array_to_string({_LOST}, ', ') AS judge_reason, 'none' AS judge_model, false AS judge_used_llm, CAST(NULL AS VARCHAR) AS judge_error, CAST(NULL AS BOOLEAN) AS judge_matches_ground_truth FROM apply_samples WHERE len({_LOST}) > 0"),
    "compact_summary": (compact_summary, None),
    "votes_by_count": (votes_by_count, f"SELECT language, votes, round(votes * 100.0 / {len(Q.MODELS)}, 1)::DOUBLE AS share, count(*) AS samples, CASE WHEN votes >= 3 THEN array_to_string(list_sort(list(index))[1:5], ',') END AS shown FROM (SELECT language, index, count(*) AS votes FROM {Q._VOTES_IN} WHERE score = 0 GROUP BY 1, 2) GROUP BY language, votes"),
    "error_reply": (error_reply, _CLASS_SQL),
    "error_ratios_by_source": (error_ratios_by_source, _RATIOS_SQL),
    "sar_flaws": (sar_flaws, _FLAW_SQL),
    "udiff_flaws": (udiff_flaws, _DRIFT_SQL),
    "language_cells": (language_cells, _CELL_SQL),
    "run_summary": (run_summary, "SELECT count(*) AS n, count(*) FILTER (prediction_raw <> '') AS success, count(*) FILTER (prediction_raw IS NULL OR prediction_raw = '') AS failed, round(sum((sample_id % 16) / 8.0), 6)::DOUBLE AS total_s, round(avg((sample_id % 16) / 8.0), 6)::DOUBLE AS mean_s FROM apply_samples"),
    "field_fallbacks": (field_fallbacks, "SELECT row_id, coalesce(CASE WHEN row_id % 3 = 1 THEN 'own' END, CASE WHEN trim(regexp_replace(extra_info.language, '\\s', ' ', 'g')) <> '' THEN extra_info.language END, '') AS language, CASE WHEN row_id % 2 = 0 THEN 0 ELSE length(reward_model.ground_truth) END AS truth_chars FROM training_rows"),
    "jsonl_strict": (jsonl_strict, "SELECT sample_id, language, length(original_code) AS n, CAST(NULL AS VARCHAR) AS error FROM apply_samples"),
    "jsonl_faults": (jsonl_faults, "SELECT count(*) FILTER (sample_id % 7 <> 0) AS good, count(*) FILTER (sample_id % 7 = 0) AS bad, count(*) AS united, 1 AS left_out FROM apply_samples"),
    "sample_load": (sample_load, "SELECT coalesce(extra_info.index, file_row_number) AS index, extra_info.language AS language, length(extra_info.original_code) AS n, md5(reward_model.ground_truth) AS truth FROM (SELECT *, row_number() OVER () - 1 AS file_row_number FROM training_rows)"),
    "parquet_by_language": (parquet_by_language, f"SELECT {S.report_lang('language')} AS language, count(*) AS n FROM apply_samples GROUP BY 1"),
}

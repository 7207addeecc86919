"""Queries for sampling, joins, votes, reports, classification and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patches as P
from ..functions import text as T
from ..operators import batching as B
from ..operators import classify as C
from ..operators import joins as J
from ..operators import reports as A
from ..operators import sampling as P1
from ..operators import votes as V
from ..operators.filters import passed
from ..operators import records as R
from ..runtime import table
from . import sql as S

MODELS = ("alder", "birch", "cedar", "dogwood", "elm")


def _apply(spark, d):
    return table(spark, d, "apply_samples")


def _scored(spark, d):
    """Samples with a score of 0 or 1 by the normal form of plain text."""
    same = T.text_form(T.wrapper_strip("prediction_raw")) == T.text_form("ground_truth")
    return _apply(spark, d).select("sample_id", "language", F.coalesce(same, F.lit(False)).cast("double").alias("score"))


_SCORED = f"(SELECT sample_id, {S.report_lang('language')} AS language, CASE WHEN {S.text_form(S.unwrapped('prediction_raw'))} = {S.text_form('ground_truth')} THEN 1.0 ELSE 0.0 END AS score FROM apply_samples)"


def accuracy_by_language(spark, d):
    return A.accuracy(_scored(spark, d), T.report_language("language"))


def accuracy_rollup(spark, d):
    return A.accuracy(_scored(spark, d), T.report_language("language"), overall=True)


def _votes_in(spark, d):
    """Five models per sample whose success is a digit of a hash."""
    models = F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model")
    rows = _apply(spark, d).select(F.col("sample_id").alias("index"), T.report_language("language").alias("language"), models)
    digit = F.conv(F.substring(F.md5(F.concat("model", F.lit(":"), F.col("index").cast("string"))), 1, 2), 16, 10).cast("int")
    return rows.withColumn("score", (digit >= 110).cast("double"))


_VOTES_IN = (
    f"(SELECT index, language, model, CASE WHEN CAST('0x' || substr(md5(model || ':' || index), 1, 2) AS INTEGER) >= 110 THEN 1.0 ELSE 0.0 END AS score FROM "
    f"(SELECT sample_id AS index, {S.report_lang('language')} AS language, unnest([{', '.join(repr(m) for m in MODELS)}]) AS model FROM apply_samples))"
)
_VOTES = f"(SELECT language, index, count(*) AS votes FROM {_VOTES_IN} WHERE score = 0 GROUP BY 1, 2)"
_HIST = f"(SELECT language, votes, count(*) AS samples FROM {_VOTES} GROUP BY 1, 2)"


def vote_counts(spark, d):
    return V.counts(_votes_in(spark, d))


def vote_histogram(spark, d):
    return V.histogram(V.counts(_votes_in(spark, d)))


def fixed_threshold_filter(spark, d):
    return V.counts(_votes_in(spark, d)).where(F.col("votes") >= 4)


def _limits(spark, d, least=3):
    rows = _votes_in(spark, d)
    models = rows.groupBy("language").agg(F.countDistinct("model").alias("models"))
    return V.thresholds(V.histogram(V.counts(rows)), models, least)


def dynamic_threshold(spark, d):
    return _limits(spark, d)


_LIMITS = f"""(WITH h AS {_HIST}, m AS (SELECT language, count(DISTINCT model) AS models FROM {_VOTES_IN} GROUP BY 1), t AS (SELECT language, max(votes) AS top FROM h GROUP BY 1),
steps AS (SELECT t.language, t.top, unnest(generate_series(greatest(1, least(2, t.top)), t.top)) AS k FROM t),
ok AS (SELECT s.language, s.k FROM steps s LEFT JOIN h a ON a.language = s.language AND a.votes = s.k LEFT JOIN h b ON b.language = s.language AND b.votes = s.k + 1 WHERE coalesce(a.samples, 0) <= coalesce(b.samples, 0) OR s.k = s.top)
SELECT m.language, CAST(CASE WHEN t.top IS NULL THEN 3 ELSE least((SELECT min(k) FROM ok WHERE ok.language = m.language), m.models) END AS BIGINT) AS threshold FROM m LEFT JOIN t ON t.language = m.language)"""


def drop_voted(spark, d):
    """Samples that are left after the vote."""
    bad = V.rejected(V.counts(_votes_in(spark, d)), _limits(spark, d))
    every = _apply(spark, d).select(F.col("sample_id").alias("index"), T.report_language("language").alias("language"))
    return J.without(every, bad, ["language", "index"])


def retention_stats(spark, d):
    """How many samples each language keeps."""
    kept = drop_voted(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("kept"))
    every = _apply(spark, d).groupBy(T.report_language("language").alias("language")).agg(F.count(F.lit(1)).alias("original"))
    out = every.join(kept, "language", "left").select("language", "original", F.coalesce("kept", F.lit(0)).alias("kept"))
    return out.withColumn("removed", F.col("original") - F.col("kept")).withColumn("rate", T.percent(F.col("kept"), F.col("original")))


_KEPT = f"(SELECT s.index, s.language FROM (SELECT sample_id AS index, {S.report_lang('language')} AS language FROM apply_samples) s WHERE NOT EXISTS (SELECT 1 FROM {_VOTES} v JOIN {_LIMITS} l ON l.language = v.language WHERE v.index = s.index AND v.language = s.language AND v.votes >= l.threshold))"


def language_model_pivot(spark, d):
    return A.pivot(_votes_in(spark, d), list(MODELS))


_CELLS = ", ".join(f"round(avg(CASE WHEN model = '{m}' THEN score END), 6) AS {m}" for m in MODELS)


def markdown_report(spark, d):
    return A.markdown(A.pivot(_votes_in(spark, d), list(MODELS)), "language", list(MODELS))


_LINE = " || ' | ' || ".join(f"coalesce(printf('%.2f%%', {m} * 100), '')" for m in MODELS)
_REPORT_SQL = f"""
SELECT CASE WHEN language = 'Average' THEN 3 ELSE 2 END AS part, language AS name, '| ' || language || ' | ' || {_LINE} || ' |' AS line
FROM (SELECT CASE WHEN grouping(language) = 1 THEN 'Average' ELSE language END AS language, {_CELLS} FROM {_VOTES_IN} GROUP BY ROLLUP (language))
UNION ALL SELECT 0, '', '| language | {' | '.join(MODELS)} |' UNION ALL SELECT 1, '', '|{'---|' * (len(MODELS) + 1)}'
"""


def errors_list(spark, d):
    """A2, A3: accuracy and the first failed ids per language and model, and the mean over files."""
    per = _votes_in(spark, d).groupBy("language", "model").agg(F.round(F.avg("score"), 6).alias("accuracy"), F.min(F.when(F.col("score") == 0, F.col("index"))).alias("first_error"), F.sum((F.col("score") == 0).cast("long")).alias("errors"))
    return per.groupBy("language").agg(F.round(F.avg("accuracy"), 5).alias("macro"), F.min("first_error").alias("first_error"), F.sum("errors").alias("errors"))


def count_mismatch(spark, d):
    """A10: languages whose number of scored rows differs between two sources."""
    a = _apply(spark, d).groupBy(T.report_language("language").alias("language")).agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit("apply"))
    b = table(spark, d, "judged_samples").groupBy(T.report_language("language").alias("language")).agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit("judged"))
    out = a.union(b).groupBy("language").agg(F.countDistinct("n").alias("kinds"), F.array_join(F.array_sort(F.collect_list(F.concat("source", F.lit(":"), F.col("n").cast("string")))), ", ").alias("cells"))
    cell = F.when(F.col("kinds") > 1, F.concat("language", F.lit(" ("), "cells", F.lit(")"))).otherwise(F.concat("language", F.lit(" ("), F.regexp_extract("cells", r"(\d+)", 1), F.lit(")")))
    return out.select("language", (F.col("kinds") > 1).alias("differs"), cell.alias("cell"))


_MISMATCH_SQL = f"""SELECT language, kinds > 1 AS differs, CASE WHEN kinds > 1 THEN language || ' (' || cells || ')' ELSE language || ' (' || regexp_extract(cells, '(\\d+)', 1) || ')' END AS cell FROM
(SELECT language, count(DISTINCT n) AS kinds, array_to_string(list_sort(list(source || ':' || n)), ', ') AS cells FROM (SELECT {S.report_lang('language')} AS language, 'apply' AS source, count(*) AS n FROM apply_samples GROUP BY 1
UNION ALL SELECT {S.report_lang('language')}, 'judged', count(*) FROM judged_samples GROUP BY 1) GROUP BY language)"""


def pass_rate_rollup(spark, d):
    return A.pass_rates(table(spark, d, "judged_samples"), F.coalesce(F.col("judge_result") == "PASSED", F.lit(False)))


def verdict_counts(spark, d):
    """Verdicts per language and overall."""
    j = table(spark, d, "judged_samples").withColumn("verdict", F.coalesce("judge_result", F.lit("none")))
    out = j.rollup("language", "verdict").agg(F.count(F.lit(1)).alias("n"), F.grouping("language").alias("g1"), F.grouping("verdict").alias("g2"))
    return out.select(F.when(F.col("g1") == 1, "ALL").otherwise(F.col("language")).alias("language"), F.when(F.col("g2") == 1, "ALL").otherwise(F.col("verdict")).alias("verdict"), "n")


def test_distribution(spark, d):
    """Rows of each language and their share."""
    out = _apply(spark, d).groupBy(T.report_language("language").alias("language")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("language", "n", T.percent(F.col("n"), F.lit(A.total(out, "n"))).alias("percent"))


def quota_sample(spark, d):
    quota = table(spark, d, "quota_config").select("language", (F.col("test") / 5).cast("long").alias("n"))
    rows = _apply(spark, d).select("sample_id", T.language("language").alias("language"))
    return P1.by_quota(rows, quota, "language", "sample_id")


def train_test_split(spark, d):
    quota = table(spark, d, "quota_config").select("language", (F.col("test") / 10).cast("long").alias("test"))
    rows = _apply(spark, d).select("sample_id", T.language("language").alias("language"))
    return P1.test_first(rows, quota, "language", "sample_id")


def stratified_subset(spark, d):
    rows = _apply(spark, d).select("sample_id", T.report_language("language").alias("language"))
    return P1.share_per_group(rows, "language", "sample_id", 0.1)


_RANKED = f"(SELECT sample_id, language, row_number() OVER (PARTITION BY language ORDER BY {S.order_key('sample_id')}, sample_id) AS r, count(*) OVER (PARTITION BY language) AS n FROM (SELECT sample_id, %s AS language FROM apply_samples))"


def global_shuffle(spark, d):
    """Two tables in one hash order with an index; numbered by ranges, not in one task."""
    a = _apply(spark, d).select(F.concat(F.lit("a"), F.col("sample_id").cast("string")).alias("key"))
    b = table(spark, d, "training_rows").select(F.concat(F.lit("t"), F.col("row_id").cast("string")).alias("key"))
    rows = a.union(b).withColumn("o", P1.order_key("key")).withColumn("part", F.substring("o", 1, 2))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    shift = sizes.select("part", F.expr("coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("shift"))  # at most 256 rows
    return rows.join(F.broadcast(shift), "part").select("key", (F.expr("row_number() over (partition by part order by o, key)") - 1 + F.col("shift")).alias("index"))


def pair_description(spark, d):
    """Judged samples with the response of the same id; incomplete pairs dropped."""
    left = table(spark, d, "judged_samples").select("custom_id", "language", "original_code", "judged_at")
    left = J.last_per_key(left, ["custom_id"], ["judged_at", "language", "original_code"]).drop("judged_at")
    right = table(spark, d, "responses").select("custom_id", R.response_text("response").alias("c")).select("custom_id", T.tag_first("c", "update_snippet", F.lit("ERROR")).alias("snippet"))
    return J.complete(left, right, needed=["original_code", "snippet"]).select("custom_id", "language", F.length("original_code").alias("chars"), "snippet")


_LAST = "(SELECT * FROM judged_samples QUALIFY row_number() OVER (PARTITION BY custom_id ORDER BY judged_at DESC, language DESC, original_code DESC) = 1)"
_CONTENT = "(SELECT custom_id, response.body.choices[1].message.content AS c FROM responses)"


def _block(tag: str) -> str:
    inner = f"split_part(regexp_extract(c, '(?s)<{tag}>(.*)', 1), '</{tag}>', 1)"
    return f"CASE WHEN contains(c, '<{tag}>') THEN {S.strip(inner)} ELSE 'ERROR' END"


_PAIR_SQL = f"""SELECT l.custom_id, l.language, CAST(length(l.original_code) AS INTEGER) AS chars, r.snippet FROM {_LAST} l JOIN (SELECT custom_id, {_block('update_snippet')} AS snippet FROM {_CONTENT}) r ON r.custom_id = l.custom_id
WHERE l.original_code IS NOT NULL AND l.original_code NOT IN ('', 'ERROR') AND r.snippet IS NOT NULL AND r.snippet NOT IN ('', 'ERROR')"""


def three_way_judge_join(spark, d):
    """Request, code and judgement of the same id; texts are joined last, by id only."""
    j = table(spark, d, "judged_samples")
    ids = J.last_per_key(j.select("custom_id", "language", "judged_at", passed(F.col("judge_content")).alias("passed")), ["custom_id"], ["judged_at", "language", "passed"])
    code = table(spark, d, "responses").select("custom_id", R.response_text("response").alias("c")).select("custom_id", T.tag_all("c", "final_code").alias("code"))
    request = J.first_per_key(j.select("custom_id", "update_snippet", "judged_at"), ["custom_id"], ["judged_at", "update_snippet"]).select("custom_id", F.length("update_snippet").alias("snippet_chars"))
    return J.complete(ids.select("custom_id", "language", "passed"), code, request, needed=["code"]).select("custom_id", "language", "passed", F.length("code").alias("code_chars"), "snippet_chars")


_THREE_SQL = f"""SELECT i.custom_id, i.language, i.passed, CAST(length(c.code) AS INTEGER) AS code_chars, r.snippet_chars FROM
(SELECT custom_id, language, p AS passed FROM (SELECT *, coalesce(contains(judge_content, '<Judge>PASSED</Judge>'), false) AS p FROM judged_samples) QUALIFY row_number() OVER (PARTITION BY custom_id ORDER BY judged_at DESC, language DESC, p DESC) = 1) i
JOIN (SELECT custom_id, {S.strip("array_to_string(regexp_extract_all(coalesce(c, ''), '(?s)<final_code>(.*?)</final_code>', 1), '')")} AS code FROM {_CONTENT}) c ON c.custom_id = i.custom_id
JOIN (SELECT custom_id, CAST(length(update_snippet) AS INTEGER) AS snippet_chars FROM judged_samples QUALIFY row_number() OVER (PARTITION BY custom_id ORDER BY judged_at, update_snippet NULLS FIRST) = 1) r ON r.custom_id = i.custom_id WHERE c.code <> '' AND c.code <> 'ERROR'"""


def upsert_merge(spark, d):
    """Early and late sendings of a sample as one record, later fields winning."""
    a = _apply(spark, d).where(F.col("sample_id") % 3 != 0).select("sample_id", "repo", "message")
    b = _apply(spark, d).where(F.col("sample_id") % 3 != 1).select("sample_id", F.upper("repo").alias("repo"), "path")
    return J.upsert(a, b, "sample_id")


def resume_anti_join(spark, d):
    done = _apply(spark, d).select("sample_id", F.when(F.col("sample_id") % 4 == 0, F.col("prediction_raw")).alias("prediction"))
    return J.pending(_apply(spark, d).select("sample_id"), done, "sample_id", "prediction")


def fill_nulls(spark, d):
    base = _apply(spark, d).select("sample_id", "repo")
    return J.filled_in(base, _apply(spark, d).select("sample_id", F.col("source_file").alias("repo")), "sample_id", "repo")


def language_intersection(spark, d):
    """Languages that all three tables have."""
    name = lambda t, c: table(spark, d, t).select(T.language(c).alias("language"))
    return name("apply_samples", "language").intersect(name("judged_samples", "language")).intersect(name("quota_config", "language"))


def key_union(spark, d):
    """Languages of either table with the counts of both."""
    n = lambda t, a: table(spark, d, t).groupBy(T.report_language("language").alias("language")).agg(F.count(F.lit(1)).alias(a))
    return n("apply_samples", "samples").join(n("quota_config", "quotas"), "language", "full").select("language", F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("quotas", F.lit(0)).alias("quotas"))


def dedupe_latest(spark, d):
    """Of rows sent twice the one taken in last."""
    rows = _apply(spark, d).select("repo", "path", "commit", "index", "sample_id", "ingested_at")
    return J.last_per_key(rows.fillna("", ["repo", "path", "commit", "index"]), ["repo", "path", "commit", "index"], ["ingested_at", "sample_id"]).select("sample_id", "ingested_at")


_ERRORS = [P.NOT_FOUND, P.AMBIGUOUS, P.NO_CHANGE, P.NOT_JSON, "Empty model output", "Unexpected apply error: x", "Patch item #1 is not an object: str", "Patch item #2 must contain oldString and newString.", "Unexpected patch JSON type: int", "strange", ""]


def _sar_errors(spark, d):
    """Error messages by the digits of an id; every seventh row succeeded."""
    message = F.element_at(F.array(*[F.lit(e) for e in _ERRORS]), (F.col("sample_id") % len(_ERRORS) + 1).cast("int"))
    return _apply(spark, d).select("sample_id", F.when(F.col("sample_id") % 7 != 0, message).alias("apply_error"))


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SAR_IN = f"(SELECT sample_id, CASE WHEN sample_id % 7 <> 0 THEN [{', '.join(map(_lit, _ERRORS))}][sample_id % {len(_ERRORS)} + 1] END AS m FROM apply_samples)"
_SAR_CASE = f"""CASE WHEN m IS NULL THEN 'ok' WHEN trim(m) = '' THEN 'ok_empty_apply_error' WHEN m = 'Empty model output' THEN 'empty_model_output' WHEN starts_with(m, 'Unexpected apply error:') THEN 'unexpected_apply_error'
WHEN m = {_lit(P.NOT_JSON)} THEN 'patch_invalid_json' WHEN starts_with(m, 'Unexpected patch JSON type:') THEN 'patch_unexpected_json_type' WHEN starts_with(m, 'Patch item #') AND contains(m, ' is not an object:') THEN 'patch_item_not_object'
WHEN starts_with(m, 'Patch item #') AND contains(m, ' must contain oldString and newString.') THEN 'patch_item_missing_fields' WHEN m = {_lit(P.NO_CHANGE)} THEN 'no_changes_to_apply'
WHEN starts_with(m, 'Could not find oldString in the file.') THEN 'oldstring_not_found' WHEN starts_with(m, 'Found multiple matches for oldString.') THEN 'oldstring_multiple_matches' ELSE 'other_sar_error' END"""
_SAR_KIND = "CASE WHEN starts_with(category, 'ok') THEN 'ok' WHEN category IN ('empty_model_output', 'unexpected_apply_error') THEN 'non_sar' ELSE 'sar' END"


def sar_error_taxonomy(spark, d):
    """Errors of search-and-replace by kind and category, with shares."""
    out = _sar_errors(spark, d).select(P.sar_error(F.col("apply_error")).alias("e")).groupBy("e.kind", "e.category").agg(F.count(F.lit(1)).alias("n"))
    return out.select("kind", "category", "n", T.percent(F.col("n"), F.lit(A.total(out, "n"))).alias("percent"))


def sar_error_topk(spark, d):
    return A.top_k(_sar_errors(spark, d).where(F.col("apply_error").isNotNull()), "apply_error", 5)


def category_samples(spark, d):
    """The first three ids of each category."""
    e = _sar_errors(spark, d).select("sample_id", P.sar_error(F.col("apply_error"))["category"].alias("category"))
    first = e.withColumn("r", F.expr("row_number() over (partition by category order by sample_id)")).where("r <= 3")
    return first.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("sample_id")), ",").alias("ids"))


_REPLIES = (
    '{"verdict": "correct", "confidence": 0.9, "reason": "all good", "key_points": ["a", "b"]}', 'text before {"verdict": "Incorrect ", "confidence": 7, "reason": "", "key_points": ["p1", "p2", "p3", "p4"]} after',
    '{"verdict": "maybe", "reason": "x"}', "no json here", '{"verdict": "needs_review", "confidence": "high"}', '{"verdict": "correct", "confidence": -1, "reason": "ok"}',
)
_NORMAL = (("correct", 0.9, "all good", None), ("incorrect", 1.0, "p1; p2; p3", None), (None, 0.5, "x", "invalid_verdict: maybe"), (None, 0.5, None, "judge_json_parse_failed"), (None, 0.5, None, "missing_reason"), ("correct", 0.0, "ok", None))


def judge_normalize(spark, d):
    reply = F.element_at(F.array(*[F.lit(r) for r in _REPLIES]), (F.col("sample_id") % len(_REPLIES) + 1).cast("int"))
    out = _apply(spark, d).select("sample_id", C.judge_reply(reply).alias("j"))
    return out.select("sample_id", "j.verdict", "j.confidence", "j.reason", "j.error")


def _value(v) -> str:
    return "NULL" if v is None else repr(v) if isinstance(v, float) else _lit(v)


_JUDGE_SQL = f"SELECT sample_id, v.verdict, CAST(v.confidence AS DOUBLE) AS confidence, v.reason, v.error FROM apply_samples JOIN (VALUES {', '.join(f'({i}, {", ".join(map(_value, r))})' for i, r in enumerate(_NORMAL))}) v(k, verdict, confidence, reason, error) ON v.k = sample_id % {len(_NORMAL)}"


def fallback_decision(spark, d):
    invalid = F.size(C.gate("prediction_raw")) > 0
    score = (T.text_form(T.wrapper_strip("prediction_raw")) == T.text_form("ground_truth")).cast("double")
    missing = T.blank("original_code") | T.blank("ground_truth") | T.blank("language")
    out = _apply(spark, d).select("sample_id", C.fallback(missing, invalid, score).alias("d"))
    return out.select("sample_id", "d.verdict", "d.confidence")


_PH = "(?im)^[ \\t]*(?://|#|;|--)?[ \\t]*\\.\\.\\.[ \\t]*(?:(?:existing|more)[ \\t]*code[ \\t]*\\.\\.\\.)?[ \\t]*$"
_GATE = f"""(WITH a AS (SELECT sample_id, coalesce(prediction_raw, '') AS c FROM apply_samples),
b AS (SELECT *, instr(c, '<update_file>') AS s, CASE WHEN instr(c, '<update_file>') > 0 THEN substr(c, instr(c, '<update_file>') + 13) ELSE '' END AS tail FROM a),
e AS (SELECT *, s > 0 AND contains(tail, '</update_file>') AS ended FROM b),
p AS (SELECT *, CASE WHEN ended THEN regexp_extract(tail, '(?s)\\A(.*)</update_file>', 1) WHEN s > 0 THEN tail ELSE c END AS inn FROM e),
o AS (SELECT *, CASE WHEN s > 0 THEN {S.strip("(substr(c, 1, s - 1) || chr(10) || CASE WHEN ended THEN substr(tail, length(inn) + 15) ELSE '' END)")} ELSE '' END AS outside,
 list_transform(list_slice(regexp_extract_all({S.nl('inn')}, '{_PH}'), 1, 5), lambda x: trim(x)) AS ph FROM p)
SELECT sample_id, list_concat(list_filter([CASE WHEN s = 0 OR NOT ended THEN 'wrapper_missing_or_truncated' END, CASE WHEN {S.times('c', '<update_file>')} <> 1 OR {S.times('c', '</update_file>')} <> 1 THEN 'wrapper_count_abnormal' END,
 CASE WHEN outside <> '' THEN 'extra_text_outside_wrapper' END, CASE WHEN len(ph) > 0 THEN 'placeholder_leakage' END], lambda x: x IS NOT NULL), list_transform(list_slice(ph, 1, 3), lambda x: 'placeholder: ' || x)) AS reasons FROM o)"""
_FALL_SQL = f"""SELECT a.sample_id, CASE WHEN miss THEN 'needs_review' WHEN inv THEN 'incorrect' WHEN same THEN 'correct' ELSE 'needs_review' END AS verdict, CAST(CASE WHEN miss THEN 0.0 WHEN inv THEN 1.0 WHEN same THEN 0.95 ELSE 0.2 END AS DOUBLE) AS confidence FROM
(SELECT sample_id, {S.blank('original_code')} OR {S.blank('ground_truth')} OR {S.blank('language')} AS miss, coalesce({S.text_form(S.unwrapped('prediction_raw'))} = {S.text_form('ground_truth')}, false) AS same FROM apply_samples) a
JOIN (SELECT sample_id, len(reasons) > 0 AS inv FROM {_GATE}) g ON g.sample_id = a.sample_id"""


def output_invalid_gate(spark, d):
    return _apply(spark, d).select("sample_id", F.array_join(C.gate("prediction_raw"), "; ").alias("reasons"))


def _features():
    """Feature columns from digits of an id, so that every branch of the rules is met."""
    k = F.col("sample_id")
    return {
        "no_op_score": F.when(k % 5 == 0, 1.0).otherwise((k % 100) / 100), "patch_match_score": F.when(k % 3 == 0, 1.0).otherwise((k % 50) / 50), "actual_edit_count": k % 5,
        "side_effect_opcode_count": k % 4, "misplaced": k % 7, "missing": k % 6,
    }


_F = """(SELECT sample_id, CASE WHEN sample_id % 5 = 0 THEN 1.0 ELSE CAST(sample_id % 100 AS DOUBLE) / 100 END AS no_op, CASE WHEN sample_id % 3 = 0 THEN 1.0 ELSE CAST(sample_id % 50 AS DOUBLE) / 50 END AS pm, sample_id % 5 AS edits, sample_id % 4 AS side,
sample_id % 7 AS mis, sample_id % 6 AS miss, sample_id % 11 <> 0 AS expected, ['OUTPUT_INVALID', 'PATCH_NOT_APPLIED', 'PATCH_INCOMPLETE', 'PATCH_INCORRECT', 'WRONG_POSITION', 'OUT_OF_PATCH_SIDE_EFFECT'][(sample_id // 2) % 6 + 1] AS claimed FROM apply_samples)"""
_RULE = """SELECT *, CASE WHEN NOT expected THEN 'OUT_OF_PATCH_SIDE_EFFECT' WHEN edits = 0 AND no_op >= 0.9995 THEN 'PATCH_NOT_APPLIED' WHEN pm >= 0.99 AND side > 0 THEN 'OUT_OF_PATCH_SIDE_EFFECT' WHEN mis > 0 THEN 'WRONG_POSITION' WHEN miss > 0 THEN 'PATCH_INCOMPLETE' ELSE 'PATCH_INCORRECT' END AS et,
CASE WHEN NOT expected THEN 0.99 WHEN edits = 0 AND no_op >= 0.9995 THEN 0.99 WHEN pm >= 0.99 AND side > 0 THEN 0.92 WHEN mis > 0 THEN 0.6 ELSE 0.55 END AS conf,
CASE WHEN NOT expected AND claimed <> 'OUT_OF_PATCH_SIDE_EFFECT' THEN 'no edit was expected' WHEN claimed = 'OUT_OF_PATCH_SIDE_EFFECT' AND side = 0 THEN 'no edit outside the patch' WHEN claimed = 'PATCH_NOT_APPLIED' AND side > 0 THEN 'edits outside the patch'
WHEN claimed = 'PATCH_NOT_APPLIED' AND no_op < 0.98 AND pm > 0.3 THEN 'the patch seems applied' WHEN claimed = 'WRONG_POSITION' AND mis = 0 THEN 'no misplaced edit' END AS why FROM """ + _F


def rule_classify(spark, d):
    out = _apply(spark, d).select("sample_id", C.rule(_features(), F.col("sample_id") % 11 != 0).alias("r"))
    return out.select("sample_id", "r.error_type", "r.confidence", "r.deterministic")


def _claimed():
    return F.element_at(F.array(*[F.lit(e) for e in C.ERRORS]), (F.floor(F.col("sample_id") / 2) % 6 + 1).cast("int"))


def consistency_guard(spark, d):
    out = _apply(spark, d).select("sample_id", C.guard(_claimed(), _features(), F.col("sample_id") % 11 != 0).alias("g"))
    return out.select("sample_id", "g.error_type", "g.needs_review", "g.reason")


def merged_decision(spark, d):
    """Rule and judge as one decision."""
    expected = F.col("sample_id") % 11 != 0
    out = _apply(spark, d).select("sample_id", C.merged(C.rule(_features(), expected), _claimed(), C.guard(_claimed(), _features(), expected)).alias("m"))
    return out.select("sample_id", "m.error_type", "m.needs_review", "m.used_judge")


def error_type_ratios(spark, d):
    """The classes of the merged decisions, zero-filled."""
    return A.error_ratios(merged_decision(spark, d), C.error_types(spark))


_MERGED = f"(SELECT sample_id, CASE WHEN conf >= 0.9 THEN et WHEN why = 'no edit was expected' THEN 'OUT_OF_PATCH_SIDE_EFFECT' ELSE claimed END AS error_type, CASE WHEN conf >= 0.9 THEN false ELSE why IS NOT NULL END AS needs_review, conf < 0.9 AS used_judge FROM ({_RULE}))"


def latency_percentiles(spark, d):
    """Mean, 95th percentile and throughput per language; seconds and tokens from the text lengths."""
    rows = _apply(spark, d).select(T.report_language("language").alias("language"), (F.coalesce(F.length("prediction_raw"), F.lit(0)) / 1000.0 + 0.1).alias("s"), F.coalesce(F.length("ground_truth"), F.lit(0)).cast("double").alias("t"))
    return A.latency(rows, "language", "s", "t")


def tercile_buckets(spark, d):
    """Samples in each third by tokens of the source."""
    rows = _apply(spark, d).select(B.token_count(F.col("original_code")).cast("double").alias("tokens"))
    return A.terciles(rows, "tokens").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("tokens"), 4).alias("mean"))


_TOK = "len(regexp_extract_all(coalesce(%s, ''), '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]'))"


def token_cost(spark, d):
    """Tokens, output budgets and price per language."""
    t = B.token_count(F.col("original_code"))
    rows = _apply(spark, d).select(T.report_language("language").alias("language"), t.alias("t"), B.budgets(t).alias("b"))
    out = rows.groupBy("language").agg(F.sum("t").alias("tokens_in"), F.sum("b.verify").alias("tokens_out"), F.max("b.streamed").alias("largest"))
    return out.withColumn("cost", A.cost(F.col("tokens_in"), F.col("tokens_out")))


def token_batches(spark, d):
    rows = _apply(spark, d).select(T.report_language("language").alias("language"), "sample_id", B.token_count(F.col("original_code")).alias("tokens"))
    return B.token_batches(rows, "language", "sample_id", "tokens", limit=5000)


_BATCH_SQL = f"""WITH RECURSIVE s AS (SELECT {S.report_lang('language')} AS language, sample_id, CAST({_TOK % 'original_code'} AS BIGINT) AS tokens, row_number() OVER (PARTITION BY {S.report_lang('language')} ORDER BY sample_id) AS r FROM apply_samples),
f AS (SELECT language, sample_id, tokens, r, CAST(1 AS BIGINT) AS batch, tokens AS used FROM s WHERE r = 1
UNION ALL SELECT s.language, s.sample_id, s.tokens, s.r, CASE WHEN f.used > 0 AND f.used + s.tokens > 5000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.used > 0 AND f.used + s.tokens > 5000 THEN s.tokens ELSE f.used + s.tokens END FROM f JOIN s ON s.language = f.language AND s.r = f.r + 1)
SELECT language, sample_id, tokens, batch FROM f"""


def interval_merge(spark, d):
    """Spans of activity of each repository, a day around each sample."""
    day = _apply(spark, d).where(F.col("repo").isNotNull()).select("repo", F.expr("cast(datediff(created_at, date'2024-01-01') as bigint)").alias("day"))
    return B.merge_intervals(day.select("repo", (F.col("day") - 1).alias("s"), (F.col("day") + 1).alias("e")), "repo", "s", "e")


_MERGE_SQL = """WITH i AS (SELECT repo, date_diff('day', DATE '2024-01-01', CAST(created_at AS DATE)) - 1 AS s, date_diff('day', DATE '2024-01-01', CAST(created_at AS DATE)) + 1 AS e FROM apply_samples WHERE repo IS NOT NULL),
f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY repo ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM i),
g AS (SELECT *, sum(n) OVER (PARTITION BY repo ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT repo, min(s) AS s, max(e) AS e FROM g GROUP BY repo, k"""


def levenshtein_pairs(spark, d):
    """Distance between each message and the path's last part."""
    a, b = F.coalesce("message", F.lit("")), F.coalesce(F.element_at(F.split("path", "/"), -1), F.lit(""))
    return _apply(spark, d).select("sample_id", F.levenshtein(a, b).cast("long").alias("distance"))


def preferred_order(spark, d):
    """The position of each language in reports."""
    first = ["python", "java", "go"]
    names = _apply(spark, d).select(T.report_language("language").alias("language")).distinct()
    rank = F.expr("row_number() over (order by coalesce(array_position(array('python', 'java', 'go'), language), 0) = 0, nullif(array_position(array('python', 'java', 'go'), language), 0), language)")
    return A.in_order(names, "language", first).select("language", rank.alias("position"))


QUERIES = {
    "accuracy_by_language": (accuracy_by_language, f"SELECT language, count(*) AS samples, round(avg(score), 6) AS accuracy FROM {_SCORED} GROUP BY language"),
    "accuracy_rollup": (accuracy_rollup, f"SELECT CASE WHEN grouping(language) = 1 THEN 'ALL' ELSE language END AS language, count(*) AS samples, round(avg(score), 6) AS accuracy FROM {_SCORED} GROUP BY ROLLUP (language)"),
    "vote_counts": (vote_counts, f"SELECT * FROM {_VOTES}"),
    "vote_histogram": (vote_histogram, f"SELECT * FROM {_HIST}"),
    "fixed_threshold_filter": (fixed_threshold_filter, f"SELECT * FROM {_VOTES} WHERE votes >= 4"),
    "dynamic_threshold": (dynamic_threshold, f"SELECT * FROM {_LIMITS}"),
    "drop_voted": (drop_voted, f"SELECT * FROM {_KEPT}"),
    "retention_stats": (retention_stats, f"SELECT o.language, o.original, coalesce(k.kept, 0) AS kept, o.original - coalesce(k.kept, 0) AS removed, round(coalesce(k.kept, 0) * 100.0 / o.original, 2) AS rate FROM (SELECT {S.report_lang('language')} AS language, count(*) AS original FROM apply_samples GROUP BY 1) o LEFT JOIN (SELECT language, count(*) AS kept FROM {_KEPT} GROUP BY 1) k ON k.language = o.language"),
    "language_model_pivot": (language_model_pivot, f"SELECT CASE WHEN grouping(language) = 1 THEN 'Average' ELSE language END AS language, {_CELLS} FROM {_VOTES_IN} GROUP BY ROLLUP (language)"),
    "markdown_report": (markdown_report, _REPORT_SQL),
    "errors_list": (errors_list, f"SELECT language, round(avg(accuracy), 5) AS macro, min(first_error) AS first_error, CAST(sum(errors) AS BIGINT) AS errors FROM (SELECT language, model, round(avg(score), 6) AS accuracy, min(CASE WHEN score = 0 THEN index END) AS first_error, count(*) FILTER (score = 0) AS errors FROM {_VOTES_IN} GROUP BY 1, 2) GROUP BY language"),
    "count_mismatch": (count_mismatch, _MISMATCH_SQL),
    "pass_rate_rollup": (pass_rate_rollup, "SELECT CASE WHEN grouping(language) = 1 THEN 'ALL' ELSE coalesce(language, 'unknown') END AS language, count(*) AS total, count(*) FILTER (judge_result = 'PASSED') AS passed, count(*) - count(*) FILTER (judge_result = 'PASSED') AS failed, round(count(*) FILTER (judge_result = 'PASSED') * 100.0 / count(*), 2) AS pass_rate FROM judged_samples GROUP BY ROLLUP (language)"),
    "verdict_counts": (verdict_counts, "SELECT CASE WHEN grouping(language) = 1 THEN 'ALL' ELSE language END AS language, CASE WHEN grouping(verdict) = 1 THEN 'ALL' ELSE verdict END AS verdict, count(*) AS n FROM (SELECT language, coalesce(judge_result, 'none') AS verdict FROM judged_samples) GROUP BY ROLLUP (language, verdict)"),
    "test_distribution": (test_distribution, f"SELECT {S.report_lang('language')} AS language, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM apply_samples GROUP BY 1"),
    "quota_sample": (quota_sample, f"SELECT sample_id, r.language FROM {_RANKED % S.lang('language')} r JOIN quota_config q ON q.language = r.language WHERE r.r <= q.test // 5"),
    "train_test_split": (train_test_split, f"SELECT sample_id, r.language, CASE WHEN r.r <= q.test // 10 THEN 'test' ELSE 'train' END AS split FROM {_RANKED % S.lang('language')} r JOIN quota_config q ON q.language = r.language"),
    "stratified_subset": (stratified_subset, f"SELECT sample_id, language FROM {_RANKED % S.report_lang('language')} WHERE r <= ceil(n * 0.1)"),
    "global_shuffle": (global_shuffle, f"SELECT key, row_number() OVER (ORDER BY {S.order_key('key')}, key) - 1 AS index FROM (SELECT 'a' || sample_id AS key FROM apply_samples UNION ALL SELECT 't' || row_id FROM training_rows)"),
    "pair_description": (pair_description, _PAIR_SQL),
    "three_way_judge_join": (three_way_judge_join, _THREE_SQL),
    "upsert_merge": (upsert_merge, "SELECT coalesce(b.sample_id, a.sample_id) AS sample_id, coalesce(b.repo, a.repo) AS repo, a.message, b.path FROM (SELECT sample_id, repo, message FROM apply_samples WHERE sample_id % 3 <> 0) a FULL JOIN (SELECT sample_id, upper(repo) AS repo, path FROM apply_samples WHERE sample_id % 3 <> 1) b ON a.sample_id = b.sample_id"),
    "resume_anti_join": (resume_anti_join, "SELECT sample_id FROM apply_samples WHERE NOT (sample_id % 4 = 0 AND trim(coalesce(prediction_raw, '')) <> '')"),
    "fill_nulls": (fill_nulls, "SELECT sample_id, coalesce(repo, source_file) AS repo FROM apply_samples"),
    "language_intersection": (language_intersection, f"SELECT {S.lang('language')} AS language FROM apply_samples INTERSECT SELECT {S.lang('language')} FROM judged_samples INTERSECT SELECT {S.lang('language')} FROM quota_config"),
    "key_union": (key_union, f"SELECT coalesce(a.language, q.language) AS language, coalesce(samples, 0) AS samples, coalesce(quotas, 0) AS quotas FROM (SELECT {S.report_lang('language')} AS language, count(*) AS samples FROM apply_samples GROUP BY 1) a FULL JOIN (SELECT {S.report_lang('language')} AS language, count(*) AS quotas FROM quota_config GROUP BY 1) q ON a.language = q.language"),
    "dedupe_latest": (dedupe_latest, "SELECT sample_id, ingested_at FROM apply_samples QUALIFY row_number() OVER (PARTITION BY coalesce(repo, ''), coalesce(path, ''), coalesce(commit, ''), coalesce(index, '') ORDER BY ingested_at DESC, sample_id DESC) = 1"),
    "sar_error_taxonomy": (sar_error_taxonomy, f"SELECT {_SAR_KIND} AS kind, category, n, round(n * 100.0 / sum(n) OVER (), 2) AS percent FROM (SELECT {_SAR_CASE} AS category, count(*) AS n FROM {_SAR_IN} GROUP BY 1)"),
    "sar_error_topk": (sar_error_topk, f"SELECT m AS apply_error, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM {_SAR_IN} WHERE m IS NOT NULL GROUP BY m ORDER BY n DESC, m LIMIT 5"),
    "category_samples": (category_samples, f"SELECT category, array_to_string(list_slice(list_sort(list(sample_id)), 1, 3), ',') AS ids FROM (SELECT sample_id, {_SAR_CASE} AS category FROM {_SAR_IN}) GROUP BY category"),
    "judge_normalize": (judge_normalize, _JUDGE_SQL),
    "fallback_decision": (fallback_decision, _FALL_SQL),
    "output_invalid_gate": (output_invalid_gate, f"SELECT sample_id, array_to_string(reasons, '; ') AS reasons FROM {_GATE}"),
    "rule_classify": (rule_classify, f"SELECT sample_id, et AS error_type, CAST(conf AS DOUBLE) AS confidence, conf >= 0.9 AS deterministic FROM ({_RULE})"),
    "consistency_guard": (consistency_guard, f"SELECT sample_id, CASE WHEN why = 'no edit was expected' THEN 'OUT_OF_PATCH_SIDE_EFFECT' ELSE claimed END AS error_type, why IS NOT NULL AS needs_review, why AS reason FROM ({_RULE})"),
    "merged_decision": (merged_decision, f"SELECT * FROM {_MERGED}"),
    "error_type_ratios": (error_type_ratios, f"SELECT e.error_type, coalesce(m.n, 0) AS n, round(coalesce(m.n, 0) / CAST(sum(coalesce(m.n, 0)) OVER () AS DOUBLE), 6) AS ratio FROM (SELECT unnest([{', '.join(map(_lit, C.ERRORS))}]) AS error_type) e LEFT JOIN (SELECT error_type, count(*) AS n FROM {_MERGED} GROUP BY 1) m ON m.error_type = e.error_type"),
    "latency_percentiles": (latency_percentiles, f"SELECT language, count(*) AS n, round(avg(s), 6) AS mean_s, round(quantile_cont(s, 0.95), 6) AS p95_s, round(sum(t) / sum(s), 6) AS tokens_per_s FROM (SELECT {S.report_lang('language')} AS language, CAST(coalesce(length(prediction_raw), 0) AS DOUBLE) / 1000 + 0.1 AS s, CAST(coalesce(length(ground_truth), 0) AS DOUBLE) AS t FROM apply_samples) GROUP BY language"),
    "tercile_buckets": (tercile_buckets, f"WITH t AS (SELECT CAST({_TOK % 'original_code'} AS DOUBLE) AS tokens FROM apply_samples), c AS (SELECT quantile_cont(tokens, 1.0/3) AS a, quantile_cont(tokens, 2.0/3) AS b FROM t) SELECT CASE WHEN tokens <= a THEN 'low' WHEN tokens <= b THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n, round(avg(tokens), 4) AS mean FROM t, c GROUP BY 1"),
    "token_cost": (token_cost, f"SELECT language, CAST(sum(t) AS BIGINT) AS tokens_in, CAST(sum(CAST(floor(t * 1.8) AS BIGINT)) AS BIGINT) AS tokens_out, max(least(t * 10, 64000)) AS largest, round(sum(t) / 1e6 * 1.25 + sum(CAST(floor(t * 1.8) AS BIGINT)) / 1e6 * 5, 6) AS cost FROM (SELECT {S.report_lang('language')} AS language, CAST({_TOK % 'original_code'} AS BIGINT) AS t FROM apply_samples) GROUP BY language"),
    "token_batches": (token_batches, _BATCH_SQL),
    "interval_merge": (interval_merge, _MERGE_SQL),
    "levenshtein_pairs": (levenshtein_pairs, "SELECT sample_id, levenshtein(coalesce(message, ''), coalesce(string_split(path, '/')[-1], '')) AS distance FROM apply_samples"),
    "preferred_order": (preferred_order, f"SELECT language, row_number() OVER (ORDER BY CASE language WHEN 'python' THEN 1 WHEN 'java' THEN 2 WHEN 'go' THEN 3 ELSE 9 END, language) AS position FROM (SELECT DISTINCT {S.report_lang('language')} AS language FROM apply_samples)"),
}

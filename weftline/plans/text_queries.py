"""Queries for wrappers, tags, lines, normal forms and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import records as R
from ..operators.filters import CommitBands, commits, passed, violations
from ..runtime import table
from . import sql as S


def _apply(spark, d):
    return table(spark, d, "apply_samples")


def wrapper_strip(spark, d):
    return _apply(spark, d).select("sample_id", T.wrapper_strip("prediction_raw").alias("content"))


def wrapper_parse(spark, d):
    p = _apply(spark, d).select("sample_id", T.wrapper_parse("prediction_raw").alias("p"))
    return p.select("sample_id", "p.opens", "p.closes", "p.has_start", "p.has_end", F.length("p.content").alias("chars"), "p.outside")


_RAW = "(SELECT sample_id, coalesce(prediction_raw, '') AS c FROM apply_samples)"
_PARSE = f"""
WITH a AS (SELECT sample_id, c, instr(c, '<update_file>') AS s, CASE WHEN instr(c, '<update_file>') > 0 THEN substr(c, instr(c, '<update_file>') + 13) ELSE '' END AS tail FROM {_RAW}),
b AS (SELECT *, s > 0 AND contains(tail, '</update_file>') AS ended FROM a),
p AS (SELECT *, CASE WHEN ended THEN regexp_extract(tail, '(?s)\\A(.*)</update_file>', 1) WHEN s > 0 THEN tail ELSE c END AS inn FROM b),
o AS (SELECT *, CASE WHEN s > 0 THEN {S.strip("(substr(c, 1, s - 1) || chr(10) || CASE WHEN ended THEN substr(tail, length(inn) + 15) ELSE '' END)")} ELSE '' END AS outside FROM p)
"""
_PARSE_SQL = f"{_PARSE} SELECT sample_id, {S.times('c', '<update_file>')} AS opens, {S.times('c', '</update_file>')} AS closes, s > 0 AS has_start, ended AS has_end, CAST(length(inn) AS INTEGER) AS chars, outside FROM o"


def marker_clean(spark, d):
    return _apply(spark, d).select("sample_id", T.marker_clean("prediction_raw").alias("content"))


def tag_block_first(spark, d):
    c = R.response_text("response")
    return table(spark, d, "responses").select("custom_id", T.tag_first(c, "update_snippet", F.lit("ERROR")).alias("snippet"), T.tag_first(c, "final_code", F.lit("ERROR")).alias("final_code"))


_CONTENT = "(SELECT custom_id, response.body.choices[1].message.content AS c FROM responses)"


def _first(tag: str) -> str:
    block = f"split_part(regexp_extract(c, '(?s)<{tag}>(.*)', 1), '</{tag}>', 1)"
    return f"CASE WHEN contains(c, '<{tag}>') THEN {S.strip(block)} ELSE 'ERROR' END"


def tag_block_strict(spark, d):
    u = R.user_message("prompt")
    return table(spark, d, "training_rows").select("row_id", T.tag_strict(u, "language", "lang").alias("language"), T.tag_strict(u, "update_snippet").alias("snippet"))


_USER = "(SELECT row_id, list_filter(prompt, lambda m: m.role = 'user')[1].content AS u FROM training_rows)"


def tag_block_all(spark, d):
    return table(spark, d, "responses").select("custom_id", T.tag_all(R.response_text("response"), "final_code").alias("code"))


def response_extract(spark, d):
    r = table(spark, d, "responses").select("custom_id", R.response_text("response").alias("content"))
    return r.where(F.col("content").isNotNull())


def line_number_format(spark, d):
    one = _apply(spark, d).select("sample_id", F.coalesce("update_snippet", F.lit("")).alias("t"))
    return one.select("sample_id", *[T.numbered("t", s).alias(s) for s in ("padded", "right", "label")])


def _numbered(form: str) -> str:
    return f"array_to_string(list_transform({S.lines('t')}, lambda x, i: {form}), chr(10))"


_W = f"length(CAST(len({S.lines('t')}) AS VARCHAR))"
_NUMBERED_SQL = (
    "SELECT sample_id, "
    + _numbered(f"lpad(CAST(i AS VARCHAR), CAST({_W} AS INTEGER), ' ') || ' | ' || x") + " AS padded, "
    + _numbered(f"lpad(CAST(i AS VARCHAR), CAST({_W} AS INTEGER), ' ') || '| ' || x") + " AS right, "
    + _numbered("'L' || CAST(i AS VARCHAR) || ':' || x") + " AS label FROM (SELECT sample_id, coalesce(update_snippet, '') AS t FROM apply_samples)"
)


def numbered_probe(spark, d):
    """of the numbered snippets and the plain ones, which are recognised."""
    one = _apply(spark, d).select("sample_id", F.coalesce("update_snippet", F.lit("")).alias("t"))
    return one.select("sample_id", T.is_numbered(T.numbered("t", "right")).alias("numbered"), T.is_numbered("t").alias("plain"))


def text_equiv_pairs(spark, d):
    a, b = T.wrapper_strip("prediction_raw"), F.col("ground_truth")
    same = lambda f: F.coalesce(f(a) == f(b), F.lit(False))
    return _apply(spark, d).select("sample_id", same(T.text_form).alias("text_equal"), same(T.markdown_form).alias("markdown_equal"), same(T.sql_form).alias("sql_equal"))


_FORMS_SQL = "SELECT sample_id, " + ", ".join(
    f"coalesce({f('a')} = {f('ground_truth')}, false) AS {n}" for n, f in (("text_equal", S.text_form), ("markdown_equal", S.markdown_form), ("sql_equal", S.sql_form))
) + f" FROM (SELECT sample_id, {S.unwrapped('prediction_raw')} AS a, ground_truth FROM apply_samples)"


def filename_language(spark, d):
    stem = F.regexp_replace("source_file", r"\.jsonl$", "")
    stamped = F.concat(F.lit("model_"), T.language("language"), F.lit("_20240102_030405.jsonl"))
    return _apply(spark, d).select("sample_id", T.file_language("source_file").alias("from_source"), T.file_language(stamped).alias("from_stamped"), T.file_language(F.concat(stem, F.lit("_1.jsonl"))).alias("from_numbered"))


def _file_lang(c: str) -> str:
    p = f"string_split(regexp_replace({c}, '\\.jsonl$', ''), '_')"
    return f"CASE WHEN len({p}) < 2 THEN 'python' WHEN len({p}) >= 3 AND regexp_matches({p}[-1], '^\\d{{6}}$') AND regexp_matches({p}[-2], '^\\d{{8}}$') THEN {p}[-3] ELSE {p}[-2] END"


def language_names(spark, d):
    """The normal name and the extension of each spelling."""
    return _apply(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("language", F.lit("<null>")).alias("spelling"), T.report_language("language").alias("name"), F.coalesce(T.extension("language"), F.lit("txt")).alias("extension"), "n")


def validate_records(spark, d):
    required = ["index", "prediction_raw", "ground_truth", "original_code", "update_snippet", "language", "message"]
    out = violations(_apply(spark, d), required, required[1:6])
    return out.select("sample_id", F.size("violations").alias("n"), F.array_join("violations", "; ").alias("violations"))


_REQ = ["index", "prediction_raw", "ground_truth", "original_code", "update_snippet", "language", "message"]
_V = ", ".join([*(f"CASE WHEN \"{c}\" IS NULL THEN 'missing {c}' END" for c in _REQ), *(f"CASE WHEN {c} IS NOT NULL AND {S.blank(c)} THEN 'blank {c}' END" for c in _REQ[1:6])])
_VALID_SQL = f"SELECT sample_id, CAST(len(v) AS INTEGER) AS n, array_to_string(v, '; ') AS violations FROM (SELECT sample_id, list_filter([{_V}], lambda x: x IS NOT NULL) AS v FROM apply_samples)"


def alias_coalesce(spark, d):
    df = _apply(spark, d)
    out = [c.alias(n) for f in ("index", "repo", "path", "update_snippet") for c, n in zip(R.resolve(df, f), (f, f"{f}_from"))]
    return df.select(F.col("sample_id").alias("key"), *out)


_ALIAS_SQL = """SELECT sample_id AS key, coalesce("index", CAST(sample_id AS VARCHAR)) AS index, CASE WHEN "index" IS NOT NULL THEN 'index' ELSE 'sample_id' END AS index_from,
repo, CASE WHEN repo IS NOT NULL THEN 'repo' END AS repo_from, path, CASE WHEN path IS NOT NULL THEN 'path' END AS path_from,
coalesce(update_snippet, message) AS update_snippet, CASE WHEN update_snippet IS NOT NULL THEN 'update_snippet' WHEN message IS NOT NULL THEN 'message' END AS update_snippet_from FROM apply_samples"""


def source_coalesce(spark, d):
    """Fields of a training row from the columns, else the tagged prompt; the language is ``text`` by default."""
    u = R.user_message("prompt")
    e = F.col("extra_info")
    return table(spark, d, "training_rows").select(
        "row_id", R.first_filled(e["language"], T.tag_strict(u, "language"), F.lit("text")).alias("language"), F.length(R.first_filled(e["update_snippet"], T.tag_strict(u, "update_snippet"))).alias("snippet_chars"),
        F.concat(F.lit("file."), F.coalesce(T.extension(e["language"]), F.lit("txt"))).alias("path"),
    )


def _tag(c: str, t: str) -> str:
    return f"regexp_extract({c}, '(?s)<{t}>(.*?)</{t}>', 1)"


_SOURCE_SQL = f"""SELECT row_id, CASE WHEN NOT {S.blank('l')} THEN l WHEN NOT {S.blank(_tag('u', 'language'))} THEN {_tag('u', 'language')} ELSE 'text' END AS language,
CAST(length(CASE WHEN NOT {S.blank('s')} THEN s WHEN NOT {S.blank(_tag('u', 'update_snippet'))} THEN {_tag('u', 'update_snippet')} END) AS INTEGER) AS snippet_chars, 'file.' || coalesce({S.ext('l')}, 'txt') AS path
FROM (SELECT row_id, extra_info.language AS l, extra_info.update_snippet AS s, list_filter(prompt, lambda m: m.role = 'user')[1].content AS u FROM training_rows)"""


def commit_filter(spark, d):
    bands = CommitBands(lines=(10, 1400), old_lines=20)
    return commits(_apply(spark, d), "original_code", "ground_truth", "message", bands=bands).select("sample_id")


_COMMIT_SQL = """SELECT sample_id FROM (SELECT sample_id, original_code AS o, ground_truth AS g, message AS s, len(string_split(original_code, chr(10))) AS a, len(string_split(ground_truth, chr(10))) AS b FROM apply_samples)
WHERE o IS NOT NULL AND g IS NOT NULL AND s IS NOT NULL AND length(o) BETWEEN 45 AND 70000 AND length(g) BETWEEN 45 AND 70000 AND a BETWEEN 10 AND 1400 AND b BETWEEN 10 AND 1400
AND CAST(a AS DOUBLE) / b BETWEEN 0.7 AND 1.3 AND length(s) >= 10 AND a > 20 AND NOT regexp_matches(regexp_replace(g, '\\s', '', 'g'), '^\\d+$') AND NOT contains(s, '403 - Forbidden')"""


def placeholder_leakage(spark, d):
    found = T.placeholders(T.wrapper_strip("prediction_raw"))
    return _apply(spark, d).select("sample_id", F.size(found).alias("n"), F.array_join(found, " | ").alias("lines"))


_PH = "(?im)^[ \\t]*(?://|#|;|--)?[ \\t]*\\.\\.\\.[ \\t]*(?:(?:existing|more)[ \\t]*code[ \\t]*\\.\\.\\.)?[ \\t]*$"


def _found(c: str) -> str:
    return f"list_transform(list_slice(regexp_extract_all(coalesce({S.nl(c)}, ''), '{_PH}'), 1, 5), lambda x: trim(x))"


_PLACE_SQL = f"SELECT sample_id, CAST(len(f) AS INTEGER) AS n, array_to_string(f, ' | ') AS lines FROM (SELECT sample_id, {_found(S.unwrapped('prediction_raw'))} AS f FROM apply_samples)"


def informative_lines(spark, d):
    """telling lines of each snippet."""
    return _apply(spark, d).select("sample_id", F.size(F.filter(T.lines(F.coalesce("update_snippet", F.lit(""))), T.informative)).alias("n"))


_INFO = "length(s) > 3 AND NOT regexp_matches(s, '^[{}\\[\\]();,:+\\-*/=<>|&!.]+$') AND NOT regexp_matches(lower(s), 'existing code|more code')"
_INFO_SQL = f"SELECT sample_id, CAST(len(list_filter(list_transform({S.lines('t')}, lambda x: {S.strip('x')}), lambda s: {_INFO})) AS INTEGER) AS n FROM (SELECT sample_id, coalesce(update_snippet, '') AS t FROM apply_samples)"


def diff_probe(spark, d):
    """Texts that look like unified diffs."""
    return table(spark, d, "documents").select("doc_id", F.coalesce(T.looks_like_diff("text"), F.lit(False)).alias("diff"), T.diff_body("text")["error"].alias("error"))


_DIFF = "(regexp_matches(text, '(?m)^@@\\s+-\\d+') OR (regexp_matches(text, '(?m)^--- ') AND regexp_matches(text, '(?m)^\\+\\+\\+ ')))"
_DIFF_SQL = f"""SELECT doc_id, coalesce({_DIFF}, false) AS diff, CASE WHEN {S.blank('text')} THEN 'empty output' WHEN NOT regexp_matches(text, '(?s)<unified_diff>.*</unified_diff>') AND NOT {_DIFF} THEN 'no diff found' END AS error FROM documents"""


def middle_cut(spark, d):
    return table(spark, d, "documents").select("doc_id", T.middle_cut("text", 200).alias("text"))


_CUT_SQL = "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 100) || chr(10) || '... (content truncated, total_chars=' || length(text) || ') ...' || chr(10) || right(text, 100) END AS text FROM documents"


def think_and_fences(spark, d):
    """Reasoning removed, fenced blocks counted."""
    c = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.length(T.think_strip(c)).alias("chars"), F.size(T.fences("text")).alias("fences"))


_FENCE_SQL = """SELECT doc_id, CAST(length(regexp_replace(coalesce(text, ''), '(?is)<think[^>]*>.*?</think>', '', 'g')) AS INTEGER) AS chars,
CAST(len(list_distinct(list_concat(regexp_extract_all(coalesce(text, ''), '(?s)```(?:json|jsonc)[ \\t]*\\n(.*?)```', 1), regexp_extract_all(coalesce(text, ''), '(?s)```[^\\n`]*\\n(.*?)```', 1)))) AS INTEGER) AS fences FROM documents"""


def chat_messages(spark, d):
    """A chat is built and its user message read back."""
    chat = R.messages(R.SYSTEM, F.coalesce("update_snippet", F.lit("")))
    return _apply(spark, d).select("sample_id", F.size(chat).alias("n"), R.user_message(chat).alias("user"))


def training_rows_build(spark, d):
    """Training records from samples, and the supervised form."""
    rows = _apply(spark, d).select("sample_id", *R.training_row(F.col("source_file"), T.language("language"), F.col("original_code"), F.col("update_snippet"), F.col("ground_truth"), F.lit("train"), F.col("sample_id")), "ground_truth")
    sft = rows.select("sample_id", "extra_info", *R.sft_row("prompt", F.col("ground_truth")))
    return sft.select("sample_id", F.length(R.user_message("prompt")).alias("prompt_chars"), F.md5(F.coalesce(F.try_element_at("completion", F.lit(1))["content"], F.lit(""))).alias("completion_md5"), F.col("extra_info.index").alias("index"), F.col("extra_info.language").alias("language"))


_TRAIN_SQL = f"""SELECT sample_id, CAST(length('<language>' || coalesce({S.lang('language')}, 'text') || '</language>' || chr(10) || '<source_file>' || coalesce(original_code, '') || '</source_file>' || chr(10) || '<update_snippet>' || coalesce(update_snippet, '') || '</update_snippet>' || chr(10)) AS INTEGER) AS prompt_chars,
md5(coalesce(ground_truth, '')) AS completion_md5, sample_id AS index, {S.lang('language')} AS language FROM apply_samples"""


def id_parts(spark, d):
    """Ids taken apart and put together."""
    p = table(spark, d, "judged_samples").select("custom_id", R.split_id(F.col("custom_id")).alias("p"))
    return p.select("custom_id", "p.language", "p.row", R.make_id(F.col("p.language"), F.col("p.row")).alias("again"))


_ID_SQL = "SELECT custom_id, l AS language, r AS row, l || '-' || r AS again FROM (SELECT custom_id, regexp_extract(custom_id, '^(.*)-[^-]*$', 1) AS l, TRY_CAST(string_split(custom_id, '-')[-1] AS BIGINT) AS r FROM judged_samples)"


def verdict_tags(spark, d):
    """The verdict tag of a judge against the stored verdict."""
    return table(spark, d, "judged_samples").select("custom_id", passed(F.col("judge_content")).alias("passed"), F.coalesce(F.col("judge_result") == "PASSED", F.lit(False)).alias("stored"))


def request_kinds(spark, d):
    """The step that a request belongs to."""
    u = R.user_message("prompt")
    return table(spark, d, "training_rows").select("row_id", R.request_kind(F.concat(F.when(F.col("row_id") % 3 == 0, "<changed_code>").when(F.col("row_id") % 3 == 1, "<brief_change>").otherwise(""), F.coalesce(u, F.lit("")))).alias("kind"))


_KIND_SQL = f"SELECT row_id, CASE WHEN contains(x, '<changed_code>') THEN 'description' WHEN contains(x, '<brief_change>') THEN 'code' ELSE 'verification' END AS kind FROM (SELECT row_id, CASE row_id % 3 WHEN 0 THEN '<changed_code>' WHEN 1 THEN '<brief_change>' ELSE '' END || coalesce(u, '') AS x FROM {_USER})"


def stream_tag_strip_batch(spark, d):
    """T1 on whole texts: what the chunked stripper must give for any chunking."""
    return _apply(spark, d).select("sample_id", F.regexp_replace(F.coalesce("prediction_raw", F.lit("")), "<update_file>|</update_file>", "").alias("text"))


QUERIES = {
    "wrapper_strip": (wrapper_strip, f"SELECT sample_id, {S.unwrapped('prediction_raw')} AS content FROM apply_samples"),
    "wrapper_parse": (wrapper_parse, _PARSE_SQL),
    "marker_clean": (marker_clean, f"SELECT sample_id, {S.cleaned('prediction_raw')} AS content FROM apply_samples"),
    "tag_block_first": (tag_block_first, f"SELECT custom_id, {_first('update_snippet')} AS snippet, {_first('final_code')} AS final_code FROM {_CONTENT}"),
    "tag_block_strict": (tag_block_strict, f"SELECT row_id, {_tag('u', 'language')} AS language, {_tag('u', 'update_snippet')} AS snippet FROM {_USER}"),
    "tag_block_all": (tag_block_all, f"SELECT custom_id, {S.strip(chr(97) + 'rray_to_string(regexp_extract_all(coalesce(c, ' + chr(39) * 2 + '), ' + chr(39) + '(?s)<final_code>(.*?)</final_code>' + chr(39) + ', 1), ' + chr(39) * 2 + ')')} AS code FROM {_CONTENT}"),
    "response_extract": (response_extract, f"SELECT custom_id, c AS content FROM {_CONTENT} WHERE c IS NOT NULL"),
    "line_number_format": (line_number_format, _NUMBERED_SQL),
    "numbered_probe": (numbered_probe, "SELECT sample_id, true AS numbered, false AS plain FROM apply_samples"),
    "text_equiv_pairs": (text_equiv_pairs, _FORMS_SQL),
    "filename_language": (filename_language, f"SELECT sample_id, {_file_lang('source_file')} AS from_source, {S.lang('language')} AS from_stamped, {_file_lang(chr(40) + 'regexp_replace(source_file, ' + chr(39) + chr(92) + '.jsonl$' + chr(39) + ', ' + chr(39) * 2 + ') || ' + chr(39) + '_1.jsonl' + chr(39) + chr(41))} AS from_numbered FROM apply_samples"),
    "language_names": (language_names, f"SELECT coalesce(language, '<null>') AS spelling, {S.report_lang('language')} AS name, coalesce({S.ext('language')}, 'txt') AS extension, count(*) AS n FROM apply_samples GROUP BY language"),
    "validate_records": (validate_records, _VALID_SQL),
    "alias_coalesce": (alias_coalesce, _ALIAS_SQL),
    "source_coalesce": (source_coalesce, _SOURCE_SQL),
    "commit_filter": (commit_filter, _COMMIT_SQL),
    "placeholder_leakage": (placeholder_leakage, _PLACE_SQL),
    "informative_lines": (informative_lines, _INFO_SQL),
    "diff_probe": (diff_probe, _DIFF_SQL),
    "middle_cut": (middle_cut, _CUT_SQL),
    "think_and_fences": (think_and_fences, _FENCE_SQL),
    "chat_messages": (chat_messages, "SELECT sample_id, 2 AS n, coalesce(update_snippet, '') AS user FROM apply_samples"),
    "training_rows_build": (training_rows_build, _TRAIN_SQL),
    "id_parts": (id_parts, _ID_SQL),
    "verdict_tags": (verdict_tags, "SELECT custom_id, coalesce(contains(judge_content, '<Judge>PASSED</Judge>'), false) AS passed, coalesce(judge_result = 'PASSED', false) AS stored FROM judged_samples"),
    "request_kinds": (request_kinds, _KIND_SQL),
    "stream_tag_strip_batch": (stream_tag_strip_batch, "SELECT sample_id, regexp_replace(coalesce(prediction_raw, ''), '<update_file>|</update_file>', '', 'g') AS text FROM apply_samples"),
}

"""Queries for control filters, events, records and registered functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.register import register
from ..operators import batching as B
from ..operators import control as L
from ..operators import records as R
from ..runtime import table
from ..sources.readers import bounded
from ..streaming.tags import carried, sse, stripped_batch
from . import sql as S
from .data_queries import _MERGED, _TOK, _VOTES_IN, _votes_in, merged_decision


def overlong_prompts(spark, d):
    """Training rows whose prompt fits."""
    rows = table(spark, d, "training_rows").select("row_id", B.token_count(R.user_message("prompt")).alias("tokens"))
    return L.within_budget(rows, F.col("tokens"), 150)


def undecided_groups(spark, d):
    """Samples that some models solve and some don't."""
    return L.undecided_groups(_votes_in(spark, d).select("index", "score"), "index", "score")


def judge_usage(spark, d):
    """How often the judge was used and needs a review."""
    return merged_decision(spark, d).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("used_judge").cast("long")).alias("used"), F.sum(F.col("needs_review").cast("long")).alias("review"))


def pending_files(spark, d):
    """Batch files without an output."""
    batch = F.format_string("batch_%03d.jsonl", F.floor(F.col("sample_id") / 50).cast("int"))
    every = table(spark, d, "apply_samples").select(batch.alias("file"), (F.floor(F.col("sample_id") / 50) % 3).alias("k")).distinct()
    return L.pending_files(every.select("file"), every.where("k = 1").select(F.concat(F.lit("output_"), "file").alias("file")))


_FILES = "(SELECT DISTINCT printf('batch_%03d.jsonl', sample_id // 50) AS file, (sample_id // 50) % 3 AS k FROM apply_samples)"


def has_output(spark, d):
    """predictions that are there."""
    return table(spark, d, "apply_samples").select("sample_id", L.has_output(T.wrapper_strip("prediction_raw")).alias("has_output"))


def bounded_input(spark, d):
    """The first rows by id; the bound is the operator."""
    return bounded(table(spark, d, "apply_samples").select("sample_id", "source_file"), "sample_id", 25)


def sse_events(spark, d):
    """Events read from lines, the model carried forward to the end marker."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("r"), F.col("event_id").alias("s"), "event_type")
    line = F.when(F.col("s") % 5 == 0, "data: [DONE]").when(F.col("s") % 7 == 0, ": ping").otherwise(F.concat(F.lit('data: {"model":"'), F.col("event_type"), F.lit('","choices":[{"delta":{"content":"c'), F.col("s").cast("string"), F.lit('"}}]}')))
    e = rows.select("r", "s", sse(line).alias("e")).where(F.col("e").isNotNull())
    return carried(e.select("r", "s", "e.done", "e.content", F.col("e.model").alias("model")), "r", "s", ["model"])


_SSE_SQL = """SELECT user_id AS r, event_id AS s, event_id % 5 = 0 AS done, CASE WHEN event_id % 5 <> 0 THEN 'c' || event_id END AS content,
last_value(CASE WHEN event_id % 5 <> 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS model FROM events WHERE event_id % 5 = 0 OR event_id % 7 <> 0"""


def stream_join_chunks(spark, d):
    """T2 on finished requests: chunks out of order are joined and stripped."""
    rows = table(spark, d, "apply_samples").where(F.col("prediction_raw").isNotNull()).select(F.col("sample_id").cast("string").alias("request_id"), F.col("prediction_raw").alias("t"))
    cut = F.expr("transform(sequence(0, greatest(cast(ceil(length(t) / 97.0) as int) - 1, 0)), k -> struct(k as seq, substring(t, k * 97 + 1, 97) as chunk))")
    chunks = rows.select("request_id", F.explode(cut).alias("c")).select("request_id", "c.seq", "c.chunk")
    return stripped_batch(chunks).select("request_id", "text")


def prediction_records(spark, d):
    """Prediction records of the three kinds of answers as one shape."""
    a = table(spark, d, "apply_samples")
    kind = F.when(T.looks_like_diff("prediction_raw"), "udiff").when(F.coalesce("prediction_raw", F.lit("")).rlike(r'^\s*[\[{].*"oldString"'), "sar").otherwise("file")
    return a.select(F.coalesce(F.col("index").try_cast("long"), F.col("sample_id")).alias("index"), kind.alias("kind"), T.report_language("language").alias("language"), F.concat(F.lit("file."), F.coalesce(T.extension("language"), F.lit("txt"))).alias("name"))


_KIND = "CASE WHEN regexp_matches(prediction_raw, '(?m)^@@\\s+-\\d+') OR (regexp_matches(prediction_raw, '(?m)^--- ') AND regexp_matches(prediction_raw, '(?m)^\\+\\+\\+ ')) THEN 'udiff' WHEN regexp_matches(coalesce(prediction_raw, ''), '^\\s*[\\[{].*\"oldString\"') THEN 'sar' ELSE 'file' END"


def html_forms(spark, d):
    """E4, first stage: documents with tags in their compared form."""
    return table(spark, d, "apply_samples").where(T.language("language") == "xml").select("sample_id", T.html_form("ground_truth").alias("form"))


def sql_functions(spark, d):
    """The registered functions, used from SQL: a file with itself, and with one and with three lines more than it should have."""
    register(spark)
    table(spark, d, "apply_samples").where(F.trim(F.coalesce("ground_truth", F.lit(""))) != "").withColumn("g", F.lower(F.trim("language"))).createOrReplaceTempView("weftline_samples")
    more = lambda n: "concat(rtrim(ground_truth), '" + "\\nQZ_MORE ~~ one' , '".join([""] * n) + "\\nQZ_MORE ~~ one')"
    return spark.sql(
        f"SELECT sample_id, apply_equiv(ground_truth, ground_truth, g) AS same, apply_equiv({more(1)}, ground_truth, g) AS other, apply_equiv(CAST(NULL AS STRING), ground_truth, g) AS missing, "
        f"reward_dense(ground_truth, ground_truth, update_snippet, g) AS reward, reward_dense({more(1)}, rtrim(ground_truth), '', g) AS one_line, reward_dense({more(3)}, rtrim(ground_truth), 'QZ_MORE ~~ one', g) AS three_lines FROM weftline_samples"
    )


def diff_opcodes(spark, d):
    """D1 as a table function: the edits of each sample by kind."""
    register(spark)
    table(spark, d, "apply_samples").createOrReplaceTempView("weftline_samples")
    return spark.sql("SELECT s.sample_id, o.tag, count(*) AS n, sum(o.i2 - o.i1) AS old_lines, sum(o.j2 - o.j1) AS new_lines FROM weftline_samples s, LATERAL diff_opcodes(s.original_code, s.ground_truth) o GROUP BY s.sample_id, o.tag")


QUERIES = {
    "overlong_prompts": (overlong_prompts, f"SELECT row_id, CAST({_TOK % 'u'} AS BIGINT) AS tokens FROM (SELECT row_id, list_filter(prompt, lambda m: m.role = 'user')[1].content AS u FROM training_rows) WHERE {_TOK % 'u'} <= 150"),
    "undecided_groups": (undecided_groups, f"SELECT index, round(avg(score), 6) AS mean, count(*) AS n FROM {_VOTES_IN} GROUP BY index HAVING min(score) < max(score)"),
    "judge_usage": (judge_usage, f"SELECT count(*) AS n, count(*) FILTER (used_judge) AS used, count(*) FILTER (needs_review) AS review FROM {_MERGED}"),
    "pending_files": (pending_files, f"SELECT file FROM {_FILES} WHERE k <> 1"),
    "has_output": (has_output, f"SELECT sample_id, coalesce(trim(regexp_replace({S.unwrapped('prediction_raw')}, '\\s', ' ', 'g')) <> '', false) AS has_output FROM apply_samples"),
    "bounded_input": (bounded_input, "SELECT sample_id, source_file FROM apply_samples ORDER BY sample_id LIMIT 25"),
    "sse_events": (sse_events, _SSE_SQL),
    "stream_join_chunks": (stream_join_chunks, "SELECT CAST(sample_id AS VARCHAR) AS request_id, regexp_replace(prediction_raw, '<update_file>|</update_file>', '', 'g') AS text FROM apply_samples WHERE prediction_raw IS NOT NULL"),
    "prediction_records": (prediction_records, f"SELECT coalesce(TRY_CAST(index AS BIGINT), sample_id) AS index, {_KIND} AS kind, {S.report_lang('language')} AS language, 'file.' || coalesce({S.ext('language')}, 'txt') AS name FROM apply_samples"),
    "html_forms": (html_forms, f"SELECT sample_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(ground_truth, '\\s+', ' ', 'g'), '>\\s+<', '><', 'g'), '\\s*/\\s*>', '/>', 'g'))) AS form FROM apply_samples WHERE {S.lang('language')} = 'xml'"),
    "sql_functions": (sql_functions, "SELECT sample_id, true AS same, false AS other, false AS missing, CAST(1 AS DOUBLE) AS reward, CAST(0.65 AS DOUBLE) AS one_line, CAST(0.25 AS DOUBLE) AS three_lines FROM apply_samples WHERE trim(coalesce(ground_truth, '')) <> ''"),
    "diff_opcodes": (diff_opcodes, None),
}

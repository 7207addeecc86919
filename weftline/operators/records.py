"""Prompts, training rows and other records, and fields under several names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Names under which a logical field occurs, in order.
CANDIDATES = {
    "index": ("index", "id", "sample_id"), "language": ("language", "lang", "file_language"), "original_code": ("original_code", "old_code", "source_file", "source", "original"),
    "update_snippet": ("update_snippet", "udiff", "patch", "instruction", "edit", "message"), "ground_truth": ("ground_truth", "new_code", "final_code", "target_code", "expected_code"),
    "prediction": ("prediction", "output", "pred", "completion", "response", "model_output"), "path": ("path", "file_path"), "repo": ("repo", "repository"), "commit": ("commit", "sha"), "message": ("message", "commit_message"),
}

SYSTEM = "Merge the update snippet into the source file and return the whole file between <update_file> tags."


def resolve(df: DataFrame, field: str, candidates: tuple[str, ...] | None = None) -> tuple[Column, Column]:
    """The first non-null of a field's names as text, and which name it was."""
    there = [c for c in candidates or CANDIDATES[field] if c in df.columns]
    if not there:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    kinds = dict(df.dtypes)
    as_text = lambda c: F.to_json(c) if kinds[c].startswith(("struct", "array", "map")) else F.col(c).cast("string")
    return F.coalesce(*map(as_text, there)), F.coalesce(*[F.when(F.col(c).isNotNull(), c) for c in there])


def first_filled(*cs: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*[F.when(~T.blank(c), c) for c in cs])


def messages(system: Column | str, user: Column) -> Column:
    """R2: a chat of a system and a user message."""
    system = F.lit(system) if isinstance(system, str) else system
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(m("system", system), m("user", user))


def user_message(prompt: Column | str) -> Column:
    """The content of the first user message."""
    return F.try_element_at(F.filter(T.col(prompt), lambda m: m["role"] == "user"), F.lit(1))["content"]


def apply_prompt(language: Column, source: Column, snippet: Column) -> Column:
    """The user prompt of a full-file edit."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>\n"))
    return F.concat(tag("language", F.coalesce(language, F.lit("text"))), tag("source_file", F.coalesce(source, F.lit(""))), tag("update_snippet", F.coalesce(snippet, F.lit(""))))


def training_row(source: Column, language: Column, original: Column, snippet: Column, truth: Column, split: Column, index: Column) -> list[Column]:
    """The nested columns of a training record."""
    return [
        source.alias("data_source"), messages(SYSTEM, apply_prompt(language, original, snippet)).alias("prompt"), F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(split.alias("split"), index.cast("long").alias("index"), original.alias("original_code"), snippet.alias("update_snippet"), language.alias("language")).alias("extra_info"),
    ]


def sft_row(prompt: Column | str, truth: Column) -> list[Column]:
    """Prompt and completion for supervised training; nothing else is kept."""
    return [T.col(prompt).alias("prompt"), F.array(F.struct(F.lit("assistant").alias("role"), truth.alias("content"))).alias("completion")]


def make_id(language: Column, row: Column) -> Column:
    return F.concat_ws("-", language, row.cast("string"))


def split_id(c: Column) -> Column:
    """struct(language, row): the row follows the last hyphen."""
    return F.struct(F.regexp_extract(c, r"^(.*)-[^-]*$", 1).alias("language"), F.element_at(F.split(c, "-"), -1).try_cast("long").alias("row"))


def request_kind(prompt: Column) -> Column:
    """Which step a request belongs to."""
    return F.when(F.contains(prompt, F.lit("<changed_code>")), "description").when(F.contains(prompt, F.lit("<brief_change>")), "code").otherwise("verification")


def response_text(c: Column | str) -> Column:
    """The content of the first choice of a response envelope."""
    return F.try_element_at(T.col(c)["body"]["choices"], F.lit(1))["message"]["content"]


def language_or_extra(language: Column, extra: Column) -> Column:
    """The language of a row, else that of its extra fields as far as not blank, else an empty text."""
    filled = lambda c: F.when(F.trim(F.regexp_replace(c, r"\s", " ")) != "", c)
    return F.coalesce(filled(language), filled(extra), F.lit(""))


def truth_or_reward(final: Column, reward: Column) -> Column:
    """The final code, even if it is empty, else the truth of the reward model, else null."""
    return F.coalesce(final, reward)

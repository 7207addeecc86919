"""The construction of a data set of code edits, step by step.

Model calls are barriers: a step makes a table of requests, a ``Responder``
turns it into responses, and the next step joins them back by id. Between two
barriers everything is one lazy plan.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batching, filters, joins, records, sampling, votes
from ..operators.filters import CommitBands


class Responder(Protocol):
    """Gives (custom_id, content) for requests (custom_id, user_prompt, max_tokens); failed ids may be left out."""

    def __call__(self, requests: DataFrame) -> DataFrame: ...


def table_responder(responses: DataFrame) -> Responder:
    """Offline: answers are looked up by id."""
    return lambda requests: requests.select("custom_id").join(responses.select("custom_id", "content"), "custom_id")


def echo_responder(answer: Callable) -> Responder:
    """L8, dry run: the answer is a column expression of the prompt."""
    return lambda requests: requests.select("custom_id", answer(F.col("user_prompt")).alias("content"))


class Limiter:
    """L2: at most ``calls`` in any ``seconds``, for one partition; partitions times calls is the cap of a cluster."""

    def __init__(self, calls: int, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.seconds, self.clock, self.sleep = seconds, clock, sleep
        self.times: deque[float] = deque(maxlen=calls)

    def wait(self) -> None:
        if len(self.times) == self.times.maxlen:
            left = self.times[0] + self.seconds - self.clock()
            if left > 0:
                self.sleep(left)
        self.times.append(self.clock())


def ask(prompt: str, most: int, transports: list[Callable], retries: int, wait: Callable[[int], float], before: Callable[[], None] = lambda: None, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The answer of the first transport that gives one; all are tried before a wait.

    A transport returns a text, ``None``, or the pieces of a stream, which are joined;
    a stream that breaks off counts as no answer.
    """
    for n in range(retries + 1):
        for call in transports:
            before()
            try:
                answer = call(prompt, most)
                if answer is not None:
                    return answer if isinstance(answer, str) else "".join(answer)
            except Exception:
                continue
        if n < retries:
            sleep(wait(n))
    return None


def batched_responder(*transports: Callable, retries: int = 2, wait: Callable[[int], float] = lambda n: 2.0**n + 10, rate: tuple[int, float] | None = None, partitions: int | None = None) -> Responder:
    """Calls a model from the executors; requests without an answer after all retries are dropped.

    ``transports`` are tried in turn (a client, then plain HTTP); ``rate`` limits the
    calls of each partition, and ``partitions`` is the number of calls at a time.
    """

    def respond(requests: DataFrame) -> DataFrame:
        def run(batches):
            import pandas as pd

            limiter = Limiter(*rate) if rate else None
            for batch in batches:
                out = []
                for i, prompt, most in zip(batch.custom_id, batch.user_prompt, batch.max_tokens):
                    answer = ask(prompt, int(most), list(transports), retries, wait, limiter.wait if limiter else lambda: None)
                    if answer is not None:
                        out.append((i, answer))
                yield pd.DataFrame(out, columns=["custom_id", "content"])

        spread = requests.repartition(partitions) if partitions else requests
        return spread.select("custom_id", "user_prompt", "max_tokens").mapInPandas(run, "custom_id string, content string")

    return respond


@dataclass
class Config:
    seed: int = 42
    bands: CommitBands = field(default_factory=CommitBands)
    limit: int = batching.LIMIT
    least_errors: int = 5


def prepare(commits: DataFrame, quota: DataFrame, config: Config = Config()) -> DataFrame:
    """Step 1: filtered and sampled commits as requests for descriptions, in token batches."""
    kept = filters.commits(commits, "old_contents", "new_contents", "subject", "old_file", "new_file", config.bands)
    chosen = sampling.by_quota(kept, quota, "language", "row", config.seed)
    prompt = F.concat(F.lit("<changed_code>\n"), F.col("new_contents"), F.lit("\n</changed_code>\n<original_code>\n"), F.col("old_contents"), F.lit("\n</original_code>\n<subject>"), F.col("subject"), F.lit("</subject>"))
    rows = chosen.select(records.make_id(F.col("language"), F.col("row")).alias("custom_id"), "language", F.col("old_contents").alias("original_code"), prompt.alias("user_prompt"), F.lit(8192).cast("long").alias("max_tokens"))
    packed = batching.token_batches(rows.withColumn("tokens", batching.token_count(F.col("user_prompt"))), "language", "custom_id", "tokens", config.limit)
    return rows.join(packed.select("custom_id", "batch", "tokens"), "custom_id")


def pair_descriptions(requests: DataFrame, described: DataFrame) -> DataFrame:
    """Step 3: requests for code from the descriptions; incomplete pairs are dropped."""
    text = described.select("custom_id", F.coalesce(T.tag_first("content", "change_description"), F.col("content")).alias("description"))
    both = joins.complete(requests.select("custom_id", "language", "original_code"), text, needed=["original_code", "description"])
    prompt = F.concat(F.lit("<brief_change>\n"), F.col("description"), F.lit("\n</brief_change>\n<original_code>\n"), F.col("original_code"), F.lit("\n</original_code>"))
    return both.select("custom_id", "language", "original_code", prompt.alias("user_prompt"), (batching.token_count(prompt) * 10).alias("max_tokens"))


def pair_code(requests: DataFrame, coded: DataFrame) -> DataFrame:
    """Step 5: requests for verification from snippet and code; ``ERROR`` parts drop the pair."""
    parts = coded.select("custom_id", T.tag_first("content", "update_snippet", F.lit("ERROR")).alias("update_snippet"), F.coalesce(F.nullif(T.tag_all("content", "final_code"), F.lit("")), F.lit("ERROR")).alias("final_code"))
    both = joins.complete(requests.select("custom_id", "language", "original_code"), parts, needed=["original_code", "update_snippet", "final_code"])
    prompt = F.concat(F.lit("<update_snippet>\n"), F.col("update_snippet"), F.lit("\n</update_snippet>\n"), T.numbered("final_code", "padded"))
    return both.select("*", prompt.alias("user_prompt"), F.floor(batching.token_count(prompt) * 1.8).cast("long").alias("max_tokens"))


def judge(pairs: DataFrame, judged: DataFrame) -> DataFrame:
    """Step 7: judged samples; anything but a PASSED tag has failed."""
    verdict = judged.select("custom_id", F.col("content").alias("judge_content"), F.when(filters.passed(F.col("content")), "PASSED").otherwise("FAILED").alias("judge_result"))
    return pairs.join(verdict, "custom_id").select("custom_id", "language", "original_code", "update_snippet", "final_code", "judge_result", "judge_content")


def vote_out(passed: DataFrame, results: DataFrame, least: int) -> DataFrame:
    """Steps 9, 10: samples that too many models fail are removed; ``results`` has language, index (the id), model, score."""
    models = results.groupBy("language").agg(F.countDistinct("model").alias("models"))
    counts = votes.counts(results)
    bad = votes.rejected(counts, votes.thresholds(votes.histogram(counts), models, least))
    return joins.without(passed, bad.select("language", F.col("index").alias("custom_id")), ["language", "custom_id"])


def split(samples: DataFrame, quota: DataFrame, config: Config = Config()) -> DataFrame:
    """Step 11: training records with their split, test rows first."""
    marked = sampling.test_first(samples, quota, "language", "custom_id", config.seed)
    row = records.training_row(F.lit("weftline"), F.col("language"), F.col("original_code"), F.col("update_snippet"), F.col("final_code"), F.col("split"), records.split_id(F.col("custom_id"))["row"])
    return marked.select("custom_id", *row)


def run(commits: DataFrame, quota: DataFrame, split_quota: DataFrame, describe: Responder, code: Responder, verify: Responder, results: DataFrame, config: Config = Config()) -> DataFrame:
    """All steps; each responder's answers are cut off as a table, as a call must not be repeated."""
    from ..runtime import cut

    requests = cut(prepare(commits, quota, config))
    described = pair_descriptions(requests, cut(describe(requests)))
    pairs = pair_code(described, cut(code(described)))
    done = judge(pairs, cut(verify(pairs))).where(F.col("judge_result") == "PASSED")
    return split(vote_out(done, results, config.least_errors), split_quota, config)

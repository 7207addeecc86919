"""Token streams in chunks, in order and without wrapper tags.

Chunks of a request may arrive in any order. State holds the next number
expected, chunks that came too early and the end of the text that may begin a
tag; only the part that is sure is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAGS = ("<update_file>", "</update_file>")


class TagStripper:
    """The input without complete tags, whatever the chunks; a tag made by a removal stays."""

    def __init__(self, held: str = "", tags: tuple[str, ...] = TAGS):
        self.held, self.tags = held, tags

    def feed(self, chunk: str) -> str:
        text, out, at = self.held + chunk, [], 0
        while at < len(text):
            mark = text.find("<", at)
            if mark < 0:
                out.append(text[at:])
                at = len(text)
                break
            out.append(text[at:mark])
            at = mark
            tag = next((t for t in self.tags if text.startswith(t, at)), None)
            if tag:
                at += len(tag)
            elif any(t.startswith(text[at:]) for t in self.tags):
                break
            else:
                out.append("<")
                at += 1
        self.held = text[at:]
        return "".join(out)

    def flush(self) -> str:
        held, self.held = self.held, ""
        return held


class Reorder:
    """Chunks by number; what can be emitted without a gap comes out in order."""

    def __init__(self, expected: int = 0, early: dict[int, str] | None = None):
        self.expected, self.early = expected, dict(early or {})

    def push(self, seq: int, chunk: str) -> list[str]:
        if seq >= self.expected:
            self.early.setdefault(seq, chunk)
        out = []
        while self.expected in self.early:
            out.append(self.early.pop(self.expected))
            self.expected += 1
        return out


def sse(line: Column | str) -> Column:
    """struct(done, content, id, model) of an event line; null if it is none or can't be read."""
    c = F.col(line) if isinstance(line, str) else line
    data = F.trim(F.regexp_extract(c, r"^data:(.*)$", 1))
    v = F.try_parse_json(F.nullif(data, F.lit("")))
    get = lambda p: F.try_variant_get(v, p, "string")
    event = F.struct((data == "[DONE]").alias("done"), get("$.choices[0].delta.content").alias("content"), get("$.id").alias("id"), get("$.model").alias("model"))
    return F.when(c.startswith("data:") & ((data == "[DONE]") | v.isNotNull()), event)


def carried(df: DataFrame, request: str, seq: str, columns: list[str]) -> DataFrame:
    """T4: the last known value of each column, carried forward within a request."""
    over = lambda c: F.expr(f"last({c}, true) over (partition by {request} order by {seq} rows between unbounded preceding and current row)")
    return df.withColumns({c: over(c) for c in columns})


def stripped_batch(df: DataFrame, request: str = "request_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """The result for finished requests: chunks joined in order, tags removed by one expression.

    A request is one answer of a model, of bounded length, so its chunks may meet in one row.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct(seq, chunk))), lambda s: s[chunk])
    return df.groupBy(request).agg(F.regexp_replace(F.array_join(parts, ""), "|".join(TAGS), "").alias("text"))


def stripped_stream(chunks: DataFrame) -> DataFrame:
    """``request_id``, ``text``: pieces of the cleaned text from a stream of (request_id, seq, chunk, done).

    ``done`` marks the last chunk; a request that stays silent for ten minutes is
    flushed as far as it came.
    """
    state = "expected long, held string, last long, early string"

    def run(key: tuple, batches: Iterator[pd.DataFrame], st) -> Iterator[pd.DataFrame]:
        import json

        expected, held, last, early = st.get if st.exists else (0, "", -1, "{}")
        order = Reorder(expected, {int(k): v for k, v in json.loads(early).items()})
        strip, out = TagStripper(held), []
        if st.hasTimedOut:
            st.remove()
            rest = "".join(strip.feed(order.early[k]) for k in sorted(order.early)) + strip.flush()
            yield pd.DataFrame({"request_id": [key[0]], "text": [rest]})
            return
        for batch in batches:
            for seq, chunk, done in zip(batch.seq, batch.chunk, batch.done):
                last = int(seq) if done else last
                out += [strip.feed(x) for x in order.push(int(seq), chunk or "")]
        if last >= 0 and order.expected > last:
            out.append(strip.flush())
            st.remove()
        else:
            st.update((order.expected, strip.held, last, json.dumps(order.early)))
            st.setTimeoutDuration(600_000)
        text = "".join(out)
        if text:
            yield pd.DataFrame({"request_id": [key[0]], "text": [text]})

    return chunks.groupBy("request_id").applyInPandasWithState(run, "request_id string, text string", state, "append", "ProcessingTimeTimeout")

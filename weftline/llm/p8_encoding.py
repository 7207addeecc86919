"""Problem 8: encoding a whole corpus with a public tokenizer.

``encode`` runs each text through the transducer of :mod:`bpe`, in Arrow
batches, without a shuffle. The vocabulary is read on the driver and broadcast,
so executors need no file. Defined results: a null text gives null, an empty
text an empty list; any text length is processed whole; texts that contain the
strings of special tokens are ordinary text; an empty table gives no rows;
repeated rows come out repeated; other columns are dropped, so clashing names
can't occur.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, table
from .bpe import read_vocabulary, transducer, vocabulary_path


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``key`` and ``ids``, the token ids of ``text``."""
    held = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary or vocabulary_path()))  # one vocabulary, under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transducer(held.value)
        for batch in batches:
            flat, ends, nulls = array("i"), array("i", [0]), []
            for value in batch.column(1):
                value = value.as_py()
                if value:
                    flat.extend(coder.encode(value))
                ends.append(len(flat))
                nulls.append(value is None)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array(nulls, pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["k", "ids"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>")
    return out.withColumnRenamed("k", key)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``key`` and ``n_tokens``: as ``encode``, but only the number; null for a null text."""
    held = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary or vocabulary_path()))  # one vocabulary, under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transducer(held.value)
        for batch in batches:
            n = [None if v is None else len(coder.encode(v)) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["k", "n"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n bigint")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_tokens"))


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``key`` and ``text``: the inverse, by the incremental UTF-8 machine; null stays null."""
    held = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary or vocabulary_path()))  # one vocabulary, under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transducer(held.value)
        for batch in batches:
            texts = [None if v is None else coder.decode(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["k", "t"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(run, f"k {kind}, t string")
    return out.select(F.col("k").alias(key), F.col("t").alias("text"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))


QUERIES = {
    "p8_ids": (p8_ids, None),
    "p8_round_trip": (p8_round_trip, "SELECT doc_id, text FROM documents"),
}

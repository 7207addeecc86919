"""Problem 5: records of evaluation splits that are also in training.

Evaluation texts are normalised to their words and cut into passages of three
words. An Aho-Corasick automaton over the passages of a shard of evaluation
texts scans training texts; per evaluation text, the matched passages give the
exact similarity and the merged intervals the coverage. To scan every training
text with every shard would cost training size times shards, so a training
text goes only to the shards of evaluation texts with which it shares one of
its rarest passages. This loses nothing: the passages of every text are put in
one common order, rare ones first, and of two texts of n and m passages with
similarity s or more, the first passage they share is among the first
``n - ceil(s n) + 1`` of the one and the first ``m - ceil(s m) + 1`` of the other,
and how many of these they share bounds what they can share at all.
The order needs the ``HOT`` most frequent passages only, counted in summaries of
bounded size over all texts; any order is exact, a good one is fast. A frequent
passage is split into parts by training text, so that none is joined in one task.
Texts with the same set of passages are one class and are compared once. Shards
are cut by a fixed number of evaluation texts and further by training texts, so
a hot evaluation text is scanned for in many tasks.

Defined results: the split is compared without case and blanks, and rows of
no known split take no part; null texts and texts of fewer than three words
match nothing; repeated rows are matched each by themselves; an empty table
gives no rows; a null ``data_source`` is counted as null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, stored, table
from .p6_near_duplicates import SHINGLES
from .shingles import WORDS, mix, runs, signature
from .skew import look_up

SIMILARITY = 0.7
TEXTS, PAIRS = 100, 2000  # evaluation texts in a shard, and pairs in a block of it
HOT, SUMMARY = 65_536, 200_000  # passages that are ordered by frequency, and passages a task counts before it forgets rare ones
FIELDS = ("original_code", "ground_truth")
_STEP = np.uint64(0x9E3779B97F4A7C15)
PART = 5_000  # texts with a frequent passage that meet in one task


class Frequent:
    """Counts of passages in bounded memory: after each ``SUMMARY`` new ones the rare are forgotten."""

    def __init__(self) -> None:
        self.keys, self.times = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, tokens: np.ndarray) -> None:
        self.waiting.append(tokens)
        self.size += len(tokens)
        if self.size > SUMMARY:
            self.fold()

    def fold(self) -> None:
        every = np.concatenate([self.keys, *self.waiting])
        weights = np.concatenate([self.times, np.ones(len(every) - len(self.keys), np.int64)])
        self.keys, at = np.unique(every, return_inverse=True)
        self.times = np.bincount(at, weights, len(self.keys)).astype(np.int64)
        if len(self.keys) > HOT:
            keep = np.argpartition(-self.times, HOT)[:HOT]
            keep.sort()
            self.keys, self.times = self.keys[keep], self.times[keep]
        self.waiting, self.size = [], 0


def texts(df: DataFrame) -> DataFrame:
    """``id``, ``field``, ``train``, ``cls``, ``n``, ``words`` and ``first`` from (id, field, train, text).

    ``first`` marks the first row of its class in a task. Rows without ``id`` carry
    the summaries of frequent passages, ``keys`` and ``times``.
    """
    names = ["id", "field", "train", "cls", "n", "words", "first", "keys", "times"]
    kinds = [pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        frequent = Frequent()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for i, field, train, text in zip(*(c.to_pylist() for c in part.columns)):
                    words = WORDS((text or "").lower())
                    tokens = np.unique(runs(words))
                    if len(tokens):
                        cls = signature(tokens)
                        first = (field, train, cls) not in seen
                        if first:
                            if len(seen) > 1_000_000:
                                seen.clear()
                            seen.add((field, train, cls))
                            frequent.add(tokens)
                        rows.append((i, field, train, cls, len(tokens), " ".join(words), first, None, None))
                cols = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
        frequent.fold()
        often = frequent.times > 1
        if often.any():
            row = [None] * 7 + [frequent.keys[often].view(np.int64), frequent.times[often]]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    return df.select("id", "field", "train", "text").mapInArrow(run, "id long, field string, train boolean, cls long, n int, words string, first boolean, keys array<long>, times array<long>")


def prefixes(records: DataFrame, similarity: float) -> DataFrame:
    """``field`` (its number), ``train``, ``cls``, ``n`` and ``routes`` (the passages of the prefix, with field and part) of each class."""
    summary = records.where(F.col("id").isNull()).select(F.explode(F.arrays_zip("keys", "times")).alias("x")).groupBy("x.keys").agg(F.sum("x.times").alias("times"))
    top = summary.orderBy(F.desc("times"), "keys").limit(HOT).toPandas()  # HOT rows at most
    top = top.sort_values("keys")
    held = records.sparkSession.sparkContext.broadcast((top["keys"].to_numpy(np.int64), top["times"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                field, train, cls, words = (c.to_pylist() for c in part.columns)
                routes, n = [], []
                for f, mine, c, w in zip(field, train, cls, words):
                    tokens = np.unique(runs(w.split(" ")))
                    often = np.zeros(len(tokens), np.int64)
                    if len(keys):
                        where = np.minimum(np.searchsorted(keys, tokens.view(np.int64)), len(keys) - 1)
                        often = np.where(keys[where] == tokens.view(np.int64), times[where], 0)
                    order = np.lexsort((tokens, often))[: prefix(len(tokens), similarity)]
                    own = tokens[order] + np.uint64(FIELDS.index(f))
                    parts = 1 + often[order] // PART
                    split = parts > 1
                    if split.any():
                        more = [t + _STEP * np.uint64(k) for t, count in zip(own[split], parts[split]) for k in ([c % int(count)] if mine else range(int(count)))]
                        own = np.concatenate([own[~split], np.array(more, np.uint64)])
                    routes.append(mix(own).view(np.int64))
                    n.append(len(tokens))
                ends = pa.array(np.cumsum([0, *map(len, routes)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(routes) if routes else [], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([FIELDS.index(f) for f in field], pa.int8()), pa.array(train, pa.bool_()), pa.array(cls, pa.int64()), pa.array(n, pa.int32()), lists], ["field", "train", "cls", "n", "routes"])

    one = records.where("first").select("field", "train", "cls", "words").mapInArrow(run, "field byte, train boolean, cls long, n int, routes array<long>")
    return one.dropDuplicates(["field", "train", "cls"])


def prefix(n: int, similarity: float) -> int:
    """Of how many of its ``n`` passages, in the common order, a similar text must share one."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def candidates(records: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct (field, e, t): classes of an evaluation and a training text that may be similar by their sizes and the prefixes they share.

    Of two texts the prefix of one ends first in the common order; what they share
    up to there is in both prefixes, and no more than its rest can follow.
    """
    at = stored(prefixes(records, similarity), "prefixes")
    e = at.where(~F.col("train")).select(F.explode("routes").alias("route"), "field", F.col("cls").alias("e"), F.col("n").alias("ne"))
    t = at.where("train").select(F.explode("routes").alias("route"), F.col("cls").alias("t"), F.col("n").alias("nt"))
    fit = F.least("ne", "nt") >= F.greatest("ne", "nt") * F.lit(similarity)
    met = e.join(t, "route").where(fit).groupBy("field", "e", "t").agg(F.count(F.lit(1)).alias("shared"), F.first("ne").alias("ne"), F.first("nt").alias("nt"))
    rest = F.ceil(F.greatest("ne", "nt") * F.lit(similarity) - 1e-9) - 1
    enough = F.col("shared") + rest >= (F.col("ne") + F.col("nt")) * F.lit(similarity / (1 + similarity)) - 1e-6
    name = F.element_at(F.array(*map(F.lit, FIELDS)), F.col("field") + F.lit(1))
    return met.where(enough).select(name.alias("field"), "e", "t")


def scan(evaluation: list[tuple[int, str]], training: Iterator[tuple[int, str]], similarity: float) -> Iterator[tuple[int, int, float, float]]:
    """(e, t, similarity, coverage) of each pair that is similar enough.

    Coverage is the share of the evaluation text's words inside passages that the
    training text has too.
    """
    import ahocorasick

    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    number: dict[str, int] = {}
    owners: list[list[int]] = []
    count, places = [], []
    for k, (_, words) in enumerate(evaluation):
        w = words.split(" ")
        where: dict[int, list[int]] = {}
        for i in range(len(w) - 2):
            p = f" {w[i]} {w[i + 1]} {w[i + 2]} "
            j = number.get(p)
            if j is None:
                j = number[p] = len(owners)
                owners.append([])
                machine.add_word(p, j)
            if j not in where:
                where[j] = []
                owners[j].append(k)
            where[j].append(i)
        count.append(len(where))
        places.append((where, len(w)))
    if not owners:
        return
    machine.make_automaton()
    for t, words in training:
        hit = {j for _, j in machine.iter(f" {words} ")}
        if not hit:
            continue
        w = words.split(" ")
        n = len(set(zip(w, w[1:], w[2:])))
        shared: dict[int, list[int]] = {}
        for j in hit:
            for k in owners[j]:
                shared.setdefault(k, []).append(j)
        for k, passages in shared.items():
            s = len(passages) / (count[k] + n - len(passages))
            if s >= similarity:
                where, length = places[k]
                covered, end = 0, 0
                for i in sorted(i for j in passages for i in where[j]):
                    covered += max(0, i + 3 - max(end, i))
                    end = i + 3
                yield evaluation[k][0], t, s, covered / length


def overlaps(records: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``field``, ``e``, ``t``, ``similarity`` and ``coverage`` of classes, from stored :func:`texts`."""
    pairs = stored(candidates(records, similarity), "routes")
    records = records.where(F.col("first"))
    heads = pairs.select("field", "e").distinct()
    shards = max(1, -(-heads.count() // TEXTS))
    shard = F.pmod(F.xxhash64("field", "e"), F.lit(shards))
    pairs = pairs.withColumn("shard", shard)
    blocks = pairs.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("blocks"))
    pairs = pairs.join(blocks, "shard")
    block = F.pmod(F.xxhash64("t"), F.col("blocks"))
    left = pairs.select("shard", "field", F.col("e").alias("cls"), "blocks").distinct().select("shard", "field", "cls", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = pairs.select("shard", "field", F.col("t").alias("cls"), block.cast("int").alias("block")).distinct()
    wanted = left.select("field", "cls").union(right.select("field", "cls")).distinct()
    words = records.select("field", "cls", "words").join(wanted, ["field", "cls"], "left_semi").groupBy("field", "cls").agg(F.first("words").alias("words"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for field, evaluation in a.groupby("e_field"):
            own = b[b.t_field == field]
            out += [(field, *x) for x in scan(list(zip(evaluation.e_cls, evaluation.e_words)), zip(own.t_cls, own.t_words), similarity)]
        return pd.DataFrame(out, columns=["field", "e", "t", "similarity", "coverage"])

    a = left.join(words, ["field", "cls"]).select(*[F.col(c).alias(f"e_{c}") for c in ("shard", "block", "field", "cls", "words")])
    b = right.join(words, ["field", "cls"]).select(*[F.col(c).alias(f"t_{c}") for c in ("shard", "block", "field", "cls", "words")])
    # a training class meets the evaluation classes of a shard in one block only
    return a.groupBy("e_shard", "e_block").cogroup(b.groupBy("t_shard", "t_block")).applyInPandas(run, "field string, e long, t long, similarity double, coverage double")


def flat(df: DataFrame) -> DataFrame:
    """``id``, ``field``, ``train``, ``text`` and ``split`` from training rows with a known split."""
    split = F.lower(F.trim(F.regexp_replace("extra_info.split", r"\s", " ")))
    fields = F.array(
        F.struct(F.lit("original_code").alias("field"), F.col("extra_info.original_code").alias("text")),
        F.struct(F.lit("ground_truth").alias("field"), F.col("reward_model.ground_truth").alias("text")),
    )
    rows = df.select(F.col("row_id").alias("id"), split.alias("split"), F.explode(fields).alias("f"))
    return rows.where(F.col("split").isin("train", "validation", "test")).select("id", "f.field", (F.col("split") == "train").alias("train"), "f.text", "split")


def members(records: DataFrame) -> DataFrame:
    """The rows of :func:`texts`, without the summaries."""
    return records.where(F.col("id").isNotNull())


def row_overlaps(records: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``evaluation``, ``training``, ``field``, ``similarity`` and ``coverage`` for rows.

    The rows of a class are cut into parts of about ``PART``, which meet in tasks of their own.
    """
    rows = members(records).select("id", "field", "train", "cls")
    sizes = rows.groupBy("field", "train", "cls").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    pairs = overlaps(records, similarity)
    for side, name, train in (("e", "evaluation", False), ("t", "training", True)):
        few = sizes.where(F.col("train") == train).select("field", F.col("cls").alias(side), "parts")
        large = stored(few.where(F.col("parts") > 1), "large")  # classes of more than PART rows
        split = lambda df: df.join(large, ["field", side], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))  # noqa: B023, E731
        own = split(rows.where(F.col("train") == train).select(F.col("id").alias(name), "field", F.col("cls").alias(side))).withColumn("part", F.pmod(F.xxhash64(name), "parts")).drop("parts")
        pairs = split(pairs).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        pairs = pairs.join(own, ["field", side, "part"]).drop("part")
    return pairs.select("evaluation", "training", "field", "similarity", "coverage")


def passages(records: DataFrame, places: bool) -> DataFrame:
    """``route`` (a passage with its field) of each class's first row in a task; with ``places`` also ``cls`` and ``at``, else each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                field, cls, words = (c.to_pylist() for c in batch.slice(at, 500).columns)
                own = [mix(runs(w.split(" ")) + np.uint64(FIELDS.index(f))).view(np.int64) for f, w in zip(field, words)]
                if places:
                    n = [len(x) for x in own]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.repeat(np.array(cls, np.int64), n)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in n]))], ["route", "cls", "at"])
                else:
                    waiting += own
                    if sum(map(len, waiting)) > 8_000_000:  # 64 MB
                        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(waiting)))], ["route"])
                        waiting = []
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(waiting)))], ["route"])

    schema = "route long, cls long, at int" if places else "route long"
    return records.select("field", "cls", "words").mapInArrow(run, schema)


def row_coverage(records: DataFrame) -> DataFrame:
    """``evaluation`` and ``coverage`` of each evaluation row with three words or more in a field: the better field's share of words inside passages of any training text.

    All training texts count, also those of another length or similar to none; passages
    are distinct before they are shuffled, and repeated texts are one class. The
    matched intervals of a class are merged in one array, no longer than its text.
    """
    every = members(records)
    known = passages(every.where("train").where("first"), places=False)
    one = every.where("not train").where("first").groupBy("field", "cls").agg(F.first("words").alias("words"), F.first("n").alias("n"))
    one = one.withColumn("own", F.xxhash64("field", "cls"))  # a class of one field
    at = passages(one.select("field", F.col("own").alias("cls"), "words"), places=True).join(known, "route", "left_semi")
    spots = at.groupBy("cls").agg(F.array_sort(F.collect_set("at")).alias("at"))
    # a passage covers its three words, less what the next one covers again
    inside = F.aggregate(F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0))), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3)))), F.lit(0), lambda t, x: t + x)
    sizes = one.select("own", F.size(F.split("words", " ")).alias("n_words"))
    classes = sizes.join(spots.select(F.col("cls").alias("own"), inside.alias("inside")), "own", "left").select("own", (F.coalesce("inside", F.lit(0)) / F.col("n_words")).alias("coverage"))
    rows = every.where("not train").select(F.col("id").alias("evaluation"), F.xxhash64("field", "cls").alias("own"))
    return look_up(rows, classes, "own", F.col("evaluation")).groupBy("evaluation").agg(F.max("coverage").alias("coverage"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "training_rows").select("row_id", "extra_info.split", "extra_info.original_code", "reward_model.ground_truth")
    df = spread(df).select("row_id", F.struct("split", "original_code").alias("extra_info"), F.struct("ground_truth").alias("reward_model"))
    return stored(texts(flat(df)), "texts")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = row_overlaps(_records(spark, sf_dir))
    return rows.select(F.least("evaluation", "training").alias("row_id_a"), F.greatest("evaluation", "training").alias("row_id_b")).distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each evaluation split and source: rows, rows met in training, pairs and the mean coverage by all training texts."""
    records = _records(spark, sf_dir)
    met = row_overlaps(records).groupBy("evaluation").agg(F.countDistinct("training").alias("pairs"))
    rows = table(spark, sf_dir, "training_rows")
    split = F.lower(F.trim(F.regexp_replace("extra_info.split", r"\s", " ")))
    rows = rows.select(F.col("row_id").alias("evaluation"), split.alias("split"), "data_source").where(F.col("split").isin("validation", "test"))
    return rows.join(met, "evaluation", "left").join(row_coverage(records), "evaluation", "left").groupBy("split", "data_source").agg(
        F.count(F.lit(1)).alias("rows"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.round(F.avg("coverage"), 4).alias("coverage")
    )


#: The definition for DuckDB: shingles of each text, all texts that share one compared.
_TEXTS = """texts AS (
  SELECT row_id AS id, f AS field, CASE WHEN f = 'o' THEN extra_info.original_code ELSE reward_model.ground_truth END AS t FROM training_rows, (VALUES ('o'), ('g')) v(f)
  WHERE lower(trim(regexp_replace(extra_info.split, '\\s', ' ', 'g'))) IN ('train', 'validation', 'test')),
"""
_TRAIN = "(SELECT row_id FROM training_rows WHERE lower(trim(regexp_replace(extra_info.split, '\\s', ' ', 'g'))) = 'train')"

QUERIES = {"p5_found": (p5_found, f"WITH {_TEXTS}{SHINGLES} SELECT a AS row_id_a, b AS row_id_b FROM near_pairs WHERE (a IN {_TRAIN}) <> (b IN {_TRAIN})"), "p5_report": (p5_report, None)}

"""Problem 10: how demanding the English prose of a corpus is to read.

Each document gets distributions of length, vocabulary, syntax and cohesion
(``FEATURES``). Boosted regression trees, trained on the graded documents
(at most ``LABELLED`` of them, a documented bound), predict a grade from 1 to
3, calibrated (isotonic) by predictions for folds that keep a source together.
The trees of the folds, each trained without one fold, vote beside those of all
labels: where all of them give a document the same level, that is its ``level``.
Documents they differ on lie near a bound or where labels are sparse; these
are settled by the exact check, the two means that define the levels.
``p10_decided`` counts both, and how often the trees contradict the definition.

Defined results: only ``lang`` = en, not source files, at least 30 words and
one sentence end (fenced code taken out); other documents, null and empty
texts get no row; repeated rows are repeated; with labels in fewer than two
folds the grade may be null and the check settles all; an empty table gives no
rows. Several grades of a document are averaged, each grader weighted by
agreement with the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, stored, table
from .trees import Boosted, isotonic

LABELLED, FOLDS, WORDS_LEAST = 20_000, 5, 30
FEATURES = (
    "words_per_sentence letters_per_word sentences words sentence_spread longest_sentence long_words short_words "
    "syllables distinct_share rare_repeat commas_per_sentence linkers_per_sentence overlap paragraphs"
).split()
#: English words that open or join clauses.
LINKERS = frozenset("after although and as because before but however if insofar instead notwithstanding or provided rather since so that therefore though unless until when where whereas which while who".split())

_FENCE = re.compile(r"```.*?```", re.S)
_WORD = re.compile(r"[A-Za-z]+")
_END = re.compile(r"[.!?]+(?=\s|\Z)")
_VOWELS = re.compile(r"[aeiouy]+")


def measure(text: str | None) -> list[float] | None:
    """The features of a text, or None for too few words or no sentence end."""
    text = _FENCE.sub("", text or "")
    words = _WORD.findall(text)
    if len(words) < WORDS_LEAST:
        return None
    ends = [m.end() for m in _END.finditer(text)]
    if not ends:
        return None
    low = [w.lower() for w in words]
    sizes = np.fromiter(map(len, words), int, len(words))
    parts, at = [], 0
    for e in [*ends, len(text)]:
        part = _WORD.findall(text[at:e].lower())
        at = e
        if part:
            parts.append(part)
    spans = np.fromiter(map(len, parts), int, len(parts))
    bags = [{w for w in p if len(w) > 3} for p in parts]
    overlap = [len(a & b) / max(1, min(len(a), len(b))) for a, b in zip(bags, bags[1:])]
    distinct = len(set(low))
    return [
        len(words) / len(ends), float(sizes.sum()) / len(words), len(ends), len(words), float(spans.std()), float(spans.max()),
        float((sizes > 6).mean()), float((sizes < 4).mean()), sum(len(_VOWELS.findall(w)) or 1 for w in low) / len(low),
        distinct / len(words), sum(1 for w in set(low) if len(w) > 6) / distinct, text.count(",") / len(ends),
        sum(w in LINKERS for w in low) / len(ends), float(np.mean(overlap)) if overlap else 0.0, text.count("\n\n") + 1,
    ]


def features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``x`` (array of ``FEATURES``) of the texts that can be measured."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, x) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (x := measure(t))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.list_(pa.float64()))], ["id", "x"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id long, x array<double>")


def consensus(grades: pd.DataFrame) -> pd.DataFrame:
    """``id``, ``y`` and ``weight`` from (id, grader, grade): graders count by their agreement with the mean."""
    w = pd.Series(1.0, index=grades.index)
    for _ in range(3):
        top = (grades.grade * w).groupby(grades.id).sum()
        bottom = w.groupby(grades.id).sum()
        off = (grades.grade - grades.id.map(top / bottom)) ** 2
        w = grades.grader.map(1 / (0.1 + off.groupby(grades.grader).mean())).fillna(1.0)
    return pd.DataFrame({"y": top / bottom, "weight": bottom}).rename_axis("id").reset_index()


LEVELS = np.array(["easy", "medium", "hard"])


class Model:
    """Trees of all labels and of the folds, with the knots of their calibration; ``folds`` has the held-out predictions."""

    def __init__(self, rows: pd.DataFrame):
        self.trees, self.knots, self.voters = None, None, []
        self.folds = pd.DataFrame(columns=["fold", "y", "raw", "calibrated"])
        if not len(rows):
            return
        x, y, w = np.array(rows.x.tolist(), float), rows.y.to_numpy(float), rows.weight.to_numpy(float)
        fold = rows.fold.to_numpy()
        raw, held = np.full(len(y), np.nan), np.full(len(y), np.nan)
        for f in np.unique(fold):
            out = fold == f
            if not out.all():
                self.voters.append(Boosted().fit(x[~out], y[~out], w[~out]))
                raw[out] = self.voters[-1].predict(x[out])
        self.trees = Boosted().fit(x, y, w)
        self.knots = self._knots(raw, y)
        for f in np.unique(fold):  # error is measured with knots that have not seen the fold
            out = fold == f
            held[out] = self._calibrate(raw[out], self._knots(raw[~out], y[~out]))
        self.folds = pd.DataFrame({"fold": fold, "y": y, "raw": raw, "calibrated": held})

    @staticmethod
    def _knots(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        ok = ~np.isnan(raw)
        return isotonic(raw[ok], y[ok]) if ok.sum() >= 10 else None

    @staticmethod
    def _calibrate(raw: np.ndarray, knots: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        return np.clip(np.interp(raw, *knots) if knots is not None else raw, 1, 3)

    def grade(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The calibrated grade, and the level that all voters agree on (-1: they differ)."""
        if self.trees is None:
            return np.full(len(x), np.nan), np.full(len(x), -1)
        grades = [self._calibrate(m.predict(x), self.knots) for m in (self.trees, *self.voters)]
        votes = np.stack([np.digitize(g, (1.5, 2.5)) for g in grades])
        agreed = (votes == votes[0]).all(axis=0) & (len(self.voters) > 1)
        return grades[0], np.where(agreed, votes[0], -1)


def train(measured: DataFrame, labels: DataFrame, sources: DataFrame) -> Model:
    """Train on at most ``LABELLED`` graded documents; ``sources`` has (id, source)."""
    graded = labels.select(F.col("doc_id").alias("id"), "grader", F.col("grade").cast("double").alias("grade")).where(F.col("grade").isNotNull())
    some = graded.select("id").distinct().join(measured, "id").join(sources, "id").orderBy(F.xxhash64("id")).limit(LABELLED)
    rows = some.select("id", "x", F.pmod(F.xxhash64("source"), F.lit(FOLDS)).alias("fold")).toPandas()
    grades = graded.join(F.broadcast(some.select("id")), "id").toPandas()  # LABELLED ids at most
    if not len(rows):
        return Model(rows.assign(y=[], weight=[]))
    return Model(rows.drop_duplicates("id").merge(consensus(grades), on="id").sort_values("id"))


def definition(x: Column) -> Column:
    """The level that the two means define."""
    wps, lpw = F.element_at(x, 1), F.element_at(x, 2)
    return F.when((wps < 11) & (lpw < 4.8), "easy").when((wps > 19) & (lpw > 6), "hard").otherwise("medium")


def levels(measured: DataFrame, model: Model) -> DataFrame:
    """``id``, ``grade`` (calibrated), ``agreed`` (the level of all trees, null where they differ), ``defined`` and ``level``."""
    held = measured.sparkSession.sparkContext.broadcast(model)  # bounded: FOLDS + 1 sets of trees and at most LABELLED knots

    @F.pandas_udf("grade double, agreed string")
    def grade(x: pd.Series) -> pd.DataFrame:
        grades, agreed = held.value.grade(np.array(x.tolist(), float).reshape(len(x), len(FEATURES)))
        return pd.DataFrame({"grade": grades, "agreed": np.where(agreed < 0, None, LEVELS[agreed])})

    out = measured.withColumn("g", grade("x"))
    out = out.select("id", F.nanvl("g.grade", F.lit(None).cast("double")).alias("grade"), "g.agreed", definition(F.col("x")).alias("defined"))
    return out.withColumn("level", F.coalesce("agreed", "defined"))


def _measured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    prose = docs.where((F.col("lang") == "en") & ~F.col("kind").eqNullSafe("source_file") & F.col("text").isNotNull())
    measured = stored(features(spread(prose.select("doc_id", "text"))), "measured")
    return measured, table(spark, sf_dir, "reading_labels"), docs.select(F.col("doc_id").alias("id"), "source", "kind")


def _levels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    measured, labels, docs = _measured(spark, sf_dir)
    return levels(measured, train(measured, labels, docs.select("id", "source"))), docs


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir)[0].select(F.col("id").alias("doc_id"), "level")


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, levels and mean grade per source and kind."""
    graded, docs = _levels(spark, sf_dir)
    n = lambda level: F.count(F.when(F.col("level") == level, 1)).alias(level)
    return graded.join(docs, "id").groupBy("source", "kind").agg(F.count(F.lit(1)).alias("docs"), n("easy"), n("medium"), n("hard"), F.round(F.avg("grade"), 3).alias("mean_grade"))


def decided(graded: DataFrame) -> DataFrame:
    """Documents per level and who gave it: ``trees``, or the ``check`` where they differ; ``as_defined``: the level is that of the definition."""
    by = F.when(F.col("agreed").isNotNull(), "trees").otherwise("check")
    return graded.groupBy("level", by.alias("decided_by"), (F.col("level") == F.col("defined")).alias("as_defined")).agg(F.count(F.lit(1)).alias("docs"))


def p10_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many levels the trees give, how many the check settles, and where trees and definition differ."""
    return decided(_levels(spark, sf_dir)[0])


def p10_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out error per fold of sources: mean absolute error and share of the right grade; trees and calibration haven't seen the fold."""
    measured, labels, docs = _measured(spark, sf_dir)
    model = train(measured, labels, docs.select("id", "source"))
    rows = [(int(f), len(g), float((g.calibrated - g.y).abs().mean()), float((g.calibrated.round() == g.y.round()).mean())) for f, g in model.folds.dropna().groupby("fold")]
    return spark.createDataFrame(rows, "fold int, documents int, mean_error double, right double")


#: The definition for DuckDB: the two means, without the trees.
_DEFINED = r"""
WITH bare AS (SELECT doc_id, regexp_replace(text, '(?s)```.*?```', '', 'g') AS t FROM documents WHERE lang = 'en' AND kind IS DISTINCT FROM 'source_file' AND text IS NOT NULL),
counted AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z]+')) AS words, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters, len(regexp_extract_all(t, '[.!?]+(?:\s|\z)')) AS ends FROM bare),
means AS (SELECT doc_id, words / ends AS wps, letters / words AS lpw FROM counted WHERE words >= 30 AND ends > 0)
SELECT doc_id, CASE WHEN wps < 11 AND lpw < 4.8 THEN 'easy' WHEN wps > 19 AND lpw > 6 THEN 'hard' ELSE 'medium' END AS level FROM means
"""

QUERIES = {"p10_found": (p10_found, _DEFINED), "p10_profile": (p10_profile, None), "p10_decided": (p10_decided, None), "p10_validation": (p10_validation, None)}

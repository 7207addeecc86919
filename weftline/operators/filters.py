"""Predicates over commits and prediction records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class CommitBands:
    """The limits of the commit filter."""

    chars: tuple[int, int] = (45, 70_000)
    lines: tuple[int, int] = (20, 1400)
    ratio: tuple[float, float] = (0.7, 1.3)
    subject: int = 10
    old_lines: int = 50
    forbidden: str = "403 - Forbidden"


def commits(df: DataFrame, old: str, new: str, subject: str, old_file: str | None = None, new_file: str | None = None, bands: CommitBands = CommitBands()) -> DataFrame:
    """F1-F7 in one pass: same path, texts present, bands of characters, lines and their ratio, a telling subject."""
    o, n, s = F.col(old), F.col(new), F.col(subject)
    keep = o.isNotNull() & n.isNotNull() & s.isNotNull()
    if old_file and new_file:
        keep &= F.col(old_file) == F.col(new_file)
    keep &= F.length(o).between(*bands.chars) & F.length(n).between(*bands.chars)
    a, b = F.size(F.split(o, "\n")), F.size(F.split(n, "\n"))
    keep &= a.between(*bands.lines) & b.between(*bands.lines) & (a / b).between(*bands.ratio)
    keep &= (F.length(s) >= bands.subject) & (a > bands.old_lines)
    keep &= ~F.regexp_replace(n, r"\s", "").rlike(r"^\d+$") & ~F.contains(s, F.lit(bands.forbidden))
    return df.where(F.coalesce(keep, F.lit(False)))


def violations(df: DataFrame, required: list[str], filled: list[str], name: str = "violations") -> DataFrame:
    """``name``, what each record lacks: columns that are missing or null, and blank texts."""
    found = [F.when(F.col(c).isNull() if c in df.columns else F.lit(True), F.lit(f"missing {c}")) for c in required]
    found += [F.when(F.col(c).isNotNull() & T.blank(c), F.lit(f"blank {c}")) for c in filled if c in df.columns]
    return df.withColumn(name, F.array_compact(F.array(*found)))


def languages(df: DataFrame, wanted: list[str] | None, language: str = "language") -> DataFrame:
    """rows of the wanted languages; None for all."""
    return df if wanted is None else df.where(F.col(language).isin(*wanted))


def passed(c: Column) -> Column:
    """The verdict tag says PASSED; anything else has failed."""
    return F.coalesce(F.contains(c, F.lit("<Judge>PASSED</Judge>")), F.lit(False))


def in_range(index: Column, size: Column) -> Column:
    """an index that points into a data set."""
    return (index >= 0) & (index < size)

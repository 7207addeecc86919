"""The functions under their SQL names, and one table function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from . import compare, diffs, patches


@F.pandas_udf(BooleanType())
def apply_equiv(prediction: pd.Series, truth: pd.Series, language: pd.Series) -> pd.Series:
    """Whether two files are the same in a language."""
    norm = lambda s: None if s is None else s.replace("\r\n", "\n").replace("\r", "\n")
    return pd.Series([a is not None and b is not None and (norm(a) == norm(b) or compare.same(norm(a), norm(b), g)) for a, b, g in zip(prediction, truth, language)], dtype=bool)


@F.pandas_udf(DoubleType())
def reward_dense(prediction: pd.Series, truth: pd.Series, snippet: pd.Series, language: pd.Series) -> pd.Series:
    """D11 as one function: 1 for an equal file, else less for each wrong line."""
    out = []
    for p, t, s, g in zip(prediction, truth, snippet, language):
        if p is not None and t is not None and (p == t or compare.same(p, t, g)):
            out.append(1.0)
        else:
            patch, side = diffs.line_errors(s, t or "", p or "")
            out.append(max(0.0, 1 - diffs.PATCH_PENALTY * patch - diffs.SIDE_PENALTY * side))
    return pd.Series(out, dtype=float)


def register(spark: SparkSession) -> None:
    """Make apply_equiv, reward_dense, diff_features, unified_diff, sar_apply, udiff_apply and diff_opcodes known to SQL."""
    for name, f in (
        ("apply_equiv", apply_equiv), ("reward_dense", reward_dense), ("diff_features", diffs.diff_features), ("unified_diff", diffs.unified_diff), ("sar_apply", patches.sar_apply), ("udiff_apply", patches.udiff_apply),
    ):
        spark.udf.register(name, f)

    @F.udtf(returnType="tag string, i1 int, i2 int, j1 int, j2 int")
    class DiffOpcodes:
        def eval(self, a: str, b: str):
            yield from diffs.opcodes((a or "").splitlines(), (b or "").splitlines())

    spark.udtf.register("diff_opcodes", DiffOpcodes)

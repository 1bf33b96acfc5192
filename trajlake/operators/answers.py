"""Answers compared as tables, for texts of any length."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_answer

_CLOSED = ["yes", "no", "noanswer"]


def f1_table(df: DataFrame, key: str, prediction: str, truth: str) -> DataFrame:
    """(key, f1, precision, recall) of each row: multisets of the words of normalised answers.

    A row's words are counted where it lies, so none is shuffled; a closed answer
    (yes, no, noanswer) must be equal. Null or without a common word: zeros.
    """

    @F.pandas_udf("k long, a long, b long")
    def counts(p: pd.Series, t: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(p, t, strict=True):
            a, b = (Counter(w for w in s.split(" ") if w) for s in (x, y))
            rows.append((sum((a & b).values()), a.total(), b.total()))
        return pd.DataFrame(rows, columns=["k", "a", "b"])

    pair = df.select(key, normalize_answer(F.coalesce(prediction, F.lit(""))).alias("p"), normalize_answer(F.coalesce(truth, F.lit(""))).alias("t"))
    apart = (F.col("p") != F.col("t")) & (F.col("p").isin(_CLOSED) | F.col("t").isin(_CLOSED))
    out = pair.select(key, apart.alias("apart"), counts("p", "t").alias("c")).select(key, "apart", "c.*")
    right = (F.col("k") > 0) & ~F.col("apart")
    value = lambda c: F.when(right, c).otherwise(0.0)
    return out.select(key, value(2.0 * F.col("k") / (F.col("a") + F.col("b"))).alias("f1"), value(F.col("k") / F.col("a")).alias("precision"), value(F.col("k") / F.col("b")).alias("recall"))

"""Fuzzy comparison of short answers."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from tokenloom.functions.arith import evaluate


def best_window_ratio(a: str, b: str) -> float:
    """Similarity in 0..100 of the shorter text to the most similar stretch of the longer one."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    best = 0.0
    for i, j, size in SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks():
        at = max(0, j - i)
        best = max(best, SequenceMatcher(None, short, long[at:at + len(short)], autojunk=False).ratio())
        if best == 1.0:
            break
    return float(round(best * 100))


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([best_window_ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


def _number(text):
    v = evaluate(text, named=True)
    return float(v) if isinstance(v, (int, float)) else math.nan


@F.pandas_udf(StructType().add("score", DoubleType()).add("corr", IntegerType()))
def _open_answers(expected: pd.Series, given: pd.Series) -> pd.DataFrame:
    scores, flags = [], []
    for e, g in zip(expected, given):
        if e is None or g is None:
            scores.append(0.0), flags.append(0)
            continue
        longest = max(len(e), len(g))
        ratio = best_window_ratio(e, g) / 100 * min(len(e), len(g)) / longest if longest else 0.0
        want, got = _number(e), _number(g)
        right = ratio >= 0.98 or want == got or (want != 0 and abs((want - got) / want) < 1e-5)
        scores.append(1.0 if right else ratio), flags.append(int(right))
    return pd.DataFrame({"score": scores, "corr": flags})


_PLAIN = r"^-?[0-9]+(\.[0-9]*)?([eE][-+]?[0-9]+)?$"


def calc_score(expected: Column, predicted: Column) -> Column:
    """``STRUCT<pred, score, corr>``: the second quoted piece against the expected value.

    Equal or close numbers are settled in the JVM; the rest is compared as text in Arrow.
    """
    pieces = F.filter(F.split(predicted, '"', -1), lambda p: p != "")
    given = F.get(pieces, 1)
    number = lambda t: F.when(t.rlike(_PLAIN), t.try_cast("double"))
    want, got = number(expected), number(given)
    close = F.coalesce((want == got) | ((want != 0) & (F.abs((want - got) / F.nullif(want, F.lit(0.0))) < 1e-5)), F.lit(False))
    rest = _open_answers(F.when(~close, expected), F.when(~close, given))
    return F.struct(F.coalesce(given, F.lit("")).alias("pred"),
                    F.when(close, 1.0).otherwise(rest["score"]).alias("score"),
                    F.when(close, 1).otherwise(rest["corr"]).alias("corr"))

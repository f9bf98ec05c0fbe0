"""Indel similarity of two strings: ``2 * LCS / (len(a) + len(b))``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.text import _col


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; one big integer holds a whole row of the table."""
    head = 0
    limit = min(len(a), len(b))
    while head < limit and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < limit - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return head + tail
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return head + tail + len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x, y) for x, y in zip(a, b)], dtype="int32")


def similarity(a: Column | str, b: Column | str) -> Column:
    """Similarity between 0 and 1, ignoring case; two empty strings are equal."""
    x, y = F.lower(_col(a)), F.lower(_col(b))
    total = F.length(x) + F.length(y)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * _lcs(x, y) / total)


def at_least(similarity: Column, threshold: float) -> Column:
    """``similarity >= threshold`` for a ratio of small integers, safe at the boundary."""
    return similarity >= F.lit(threshold - 1e-12)

"""Text ratios Spark lacks, as Arrow functions over whole batches (SIM-1, SIM-2)."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship the functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel row updates."""
    # What both start or end with is common.
    ends, n = 0, min(len(a), len(b))
    while ends < n and a[ends] == b[ends]:
        ends += 1
    a, b, n = a[ends:], b[ends:], n - ends
    tail = 0
    while tail < n and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    if tail:
        a, b = a[:-tail], b[:-tail]
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return ends + tail + len(a) - bin(row).count("1")


def indel_ratio(a: str, b: str) -> float:
    """2 * LCS / total length in percent, rounded."""
    total = len(a) + len(b)
    if total == 0 or a == b:
        return 100.0
    return float(round(100.0 * 2 * lcs_length(a, b) / total))


def longest_common(a: str, b: str) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest substring both have; of several, the first in a, then in b.

    If they share a substring of some length they share one of every smaller length, so the length is bisected.
    """
    low, high, best = 0, min(len(a), len(b)), (0, 0, 0)
    while low < high:
        n = (low + high + 1) // 2
        have = {b[j:j + n] for j in range(len(b) - n + 1)}
        at = next((i for i in range(len(a) - n + 1) if a[i:i + n] in have), None)
        if at is None:
            high = n - 1
        else:
            low, best = n, (at, b.find(a[at:at + n]), n)
    return best


def block_ratio(a: str, b: str) -> float:
    """2 * characters in matching blocks / total length: the longest common substring, then the same left and right of it."""
    if not a and not b:
        return 1.0
    matched, todo = 0, [(a, b)]
    while todo:
        x, y = todo.pop()
        i, j, n = longest_common(x, y)
        if n:
            matched += n
            todo += [(x[:i], y[:j]), (x[i + n:], y[j + n:])]
    return 2.0 * matched / (len(a) + len(b))


def _ratio_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    """Each distinct pair of a batch is compared once: names and titles repeat."""
    pairs = [*zip(a, b)]
    seen = {p: None if p[0] is None or p[1] is None else indel_ratio(*p) for p in set(pairs)}
    return pd.Series([seen[p] for p in pairs], dtype="float64")


def _sequence_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else block_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """SIM-1 in percent. Null arguments give null."""
    return F.pandas_udf(_ratio_batch, T.DoubleType())(a, b)


def sequence_ratio(a: Column, b: Column) -> Column:
    """SIM-2: matching-block ratio, 0..1."""
    return F.pandas_udf(_sequence_batch, T.DoubleType())(a, b)

"""Lexical diversity. Counts are whole numbers, so that ratios are the same whatever the order of work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, THRESHOLD, LEAST = 50, 0.72, 50


def ttr(words: Column) -> Column:
    return F.when(F.size(words) > 0, F.size(F.array_distinct(words)) / F.size(words)).otherwise(0.0)


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def neighbours(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of each word's previous (-1: none) and next (the number of words: none) occurrence."""
    codes = pd.factorize(words)[0]
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    before, after = np.full(len(codes), -1), np.full(len(codes), len(codes))
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


@F.pandas_udf(_longs("distinct_in_windows", "windows", "hapax"))
def window_counts(words: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Per word list: distinct words summed over all windows of WINDOW words, the number of windows, words that occur once.

    A word at i with its previous occurrence at p is the first of its kind in the windows that start after p
    and hold i. A shorter list is one window; an empty or null one has none.
    """

    def counts(w: np.ndarray) -> tuple[int, int, int]:
        n, width, at = len(w), min(WINDOW, len(w)), np.arange(len(w))
        before, after = neighbours(w)
        firsts = np.minimum(at, n - width) - np.maximum(np.maximum(before + 1, at - width + 1), 0) + 1
        return int(np.maximum(firsts, 0).sum()), n - width + 1, int(((before < 0) & (after == n)).sum())

    for batch in words:
        rows = [(0, 0, 0) if w is None or not len(w) else counts(w) for w in batch]
        yield pd.DataFrame(rows, columns=["distinct_in_windows", "windows", "hapax"])


def mattr(words: Column, counts: Column) -> Column:
    """Moving-average type-token ratio from window_counts."""
    width = F.least(F.lit(WINDOW), F.size(words))
    return F.when(F.size(words) > 0, counts["distinct_in_windows"] / (width * counts["windows"])).otherwise(0.0)


def _factors(before: np.ndarray) -> tuple[int, int, int]:
    """Full factors, and types and words of what remains after the last one, from previous occurrences.

    A word is new to the factor that starts at s when its previous occurrence lies before s, so a running sum
    gives the types at every length, and the first length at or below the threshold ends the factor.
    """
    full, start, span, n = 0, 0, 2 * WINDOW, len(before)
    while True:
        types = np.cumsum(before[start : start + span] < start)
        low = np.flatnonzero(types / np.arange(1, len(types) + 1) <= THRESHOLD)
        if len(low):
            full, start, span = full + 1, start + int(low[0]) + 1, 2 * WINDOW
        elif start + span < n:
            span *= 4
        else:
            return full, int(types[-1]) if len(types) else 0, n - start


@F.pandas_udf(_longs("f_full", "f_types", "f_count", "b_full", "b_types", "b_count"))
def mtld_counts(words: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Per word list, forward and backward: full factors, and types and words of the part that remains."""

    def both_ways(w: np.ndarray) -> tuple[int, ...]:
        before, after = neighbours(w)
        return _factors(before) + _factors((len(w) - 1 - after)[::-1])

    for batch in words:
        rows = [(0,) * 6 if w is None else both_ways(w) for w in batch]
        yield pd.DataFrame(rows, columns=["f_full", "f_types", "f_count", "b_full", "b_types", "b_count"])


def mtld(n: Column, counts: Column) -> Column:
    """Mean over both directions of words / factors; 0 for fewer than LEAST words."""

    def one_way(side: str) -> Column:
        part = F.when(counts[f"{side}_count"] > 0, (1 - counts[f"{side}_types"] / counts[f"{side}_count"]) / F.lit(1 - THRESHOLD)).otherwise(0.0)
        factors = counts[f"{side}_full"] + part
        return F.when(factors > 0, n / factors).otherwise(n.cast("double"))

    return F.when(n < LEAST, 0.0).otherwise((one_way("f") + one_way("b")) / 2)

"""Locally weighted lines over series of any length: blocks of consecutive points with the halo that their windows need."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longtext.operators.ranges import Save, blocks, broadcast_if_small, medians, placed

#: Points of a block at least; a block is as long as a window where that is longer, so that halos are at most twice the rows.
LEAST_BLOCK = 2048
#: Distances and deviations up to this are none.
TINY = 1e-12


def windows(x: np.ndarray, first: int, last: int, near: int) -> np.ndarray:
    """Where the window of the `near` nearest points begins, for each of the sorted points first..last-1; it only moves to the right."""
    starts = np.empty(last - first, np.int64)
    at = 0
    for i in range(first, last):
        at = max(at, i - near + 1)
        while at + near < len(x) and x[at + near] - x[i] < x[i] - x[at]:
            at += 1
        starts[i - first] = at
    return starts


def fits(x: np.ndarray, y: np.ndarray, trust: np.ndarray, first: int, last: int, near: int) -> np.ndarray:
    """Values at points first..last-1 of the weighted lines through their windows: tricube weights times trust."""
    near = min(near, len(x))
    out = np.empty(last - first)
    for i, at in zip(range(first, last), windows(x, first, last, near), strict=True):
        part = slice(at, at + near)
        d = x[part] - x[i]
        far = np.abs(d)
        h = max(far[0], far[-1], TINY)
        w = np.clip(1 - (far / h) ** 3, 0, None) ** 3 * trust[part]
        s = w.sum()
        if s <= 0:  # no point of the window is trusted
            w, s = np.ones(near), float(near)
        mx, my = (w * d).sum() / s, (w * y[part]).sum() / s
        spread = (w * (d - mx) ** 2).sum()
        slope = (w * (d - mx) * (y[part] - my)).sum() / spread if spread > TINY else 0.0
        out[i - first] = my - slope * mx
    return out


def smoothed(df: DataFrame, key: str, x: str, y: str, save: Save, share: float = 0.7, near: int | None = None, robust: int = 3, most: int = 1_000_000) -> DataFrame:
    """(key, x, y, smooth): lines through the nearest `share` of a key's points, or the nearest `near` points, then `robust` rounds of bisquare reweighting.

    Points are placed by (x, y) within their key. A window is consecutive points, so a block of them needs no more than a window's length on
    either side; work is the points times the window. With `share` the window grows with the series, so long series want `near`.
    Each round's deviations are weighed by their exact median (see medians()). Rows with a null in x or y are left out; a key of
    one point is its own line; equal x are taken in order of y.
    """
    points = df.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    points = placed(points, "k", ["x", "y"], save, "lowess")
    wanted = F.lit(near).cast("long") if near else F.floor(share * F.col("_n") + 1e-10)
    points = points.withColumn("near", F.greatest(F.lit(1), F.least("_n", F.greatest(F.lit(2), wanted))).cast("long"))
    points = save(points.withColumn("trust", F.lit(1.0)), "lowess-points")
    kind = df.schema[key].dataType.simpleString()
    shape = f"k {kind}, x double, y double, idx long, _n long, near long, trust double, fit double"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        own = rows["_own"].to_numpy()
        first, last = int(own.argmax()), len(own) - int(own[::-1].argmax())
        found = fits(rows["x"].to_numpy(), rows["y"].to_numpy(), rows["trust"].to_numpy(), first, last, int(rows["near"].iloc[0]))
        return rows.iloc[first:last].assign(fit=found)[["k", "x", "y", "idx", "_n", "near", "trust", "fit"]]

    size = F.greatest(F.lit(LEAST_BLOCK).cast("long"), F.col("near"))
    for turn in range(robust + 1):
        dealt = blocks(points, F.col("near") - 1, F.col("near") - 1, size)
        fitted = save(dealt.groupBy("k", "_block").applyInPandas(run, shape), f"lowess-{turn}")
        if turn == robust:
            break
        off = fitted.withColumn("off", F.abs(F.col("y") - F.col("fit")))
        scale = medians(off, "k", "off", save, most).select(F.col("k").alias("_key"), "median")
        both = off.join(broadcast_if_small(scale), F.col("k").eqNullSafe(F.col("_key")))
        # a series that its lines meet keeps its weights
        trust = F.when(F.col("median") <= TINY, F.col("trust")).otherwise(F.pow(F.greatest(F.lit(0.0), 1 - F.pow(F.col("off") / (6 * F.col("median")), F.lit(2.0))), F.lit(2.0)))
        points = both.select("k", "x", "y", "idx", "_n", "near", trust.alias("trust"))
    return fitted.select(F.col("k").alias(key), "x", "y", F.col("fit").alias("smooth"))

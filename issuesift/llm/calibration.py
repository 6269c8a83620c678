"""Isotonic calibration of raw scores by counts per bin."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024


def bin_of(raw: Column, lo: float, hi: float, bins: int = BINS) -> Column:
    """Bin 0..bins-1 of a raw score; scores outside [lo, hi] go to the ends."""
    x = (raw - F.lit(lo)) / F.lit((hi - lo) / bins)
    return F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(bins - 1)).cast("int")


def pool(n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing rates closest to pos / n."""
    blocks: list[list[float]] = []
    for c, p in zip(n, pos, strict=True):
        blocks.append([float(c), float(p), 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            c2, p2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + c2, blocks[-1][1] + p2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), (p + 0.5) / (c + 1.0)) for c, p, k in blocks])


def isotonic(train: DataFrame, bins: int = BINS) -> list[float] | None:
    """The calibrated score of every bin, from rows ``bin``, ``label`` (0/1).
    The driver gets one count per bin. Bins between two seen ones are
    interpolated. None without rows."""
    rows = train.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r["bin"])
    fit = pool(np.array([r["n"] for r in rows]), np.array([r["pos"] for r in rows]))
    fit = np.maximum.accumulate(fit)
    return np.interp(np.arange(bins), [r["bin"] for r in rows], fit).round(6).tolist()


def calibrated(bin_col: Column, curve: list[float] | None) -> Column:
    if curve is None:
        return F.lit(0.0)
    return F.element_at(F.lit(curve), bin_col + 1)

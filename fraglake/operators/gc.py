"""GC correction by LOWESS, one sample a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lowess(y: np.ndarray, x: np.ndarray, frac: float, rounds: int = 3) -> np.ndarray:
    """Locally weighted linear regression with ``rounds`` robustifying reweights: the fitted value at each x."""
    n = len(x)
    near = min(n, max(2, int(frac * n + 1e-10)))
    order = np.argsort(x, kind="stable")
    xs, ys = x[order].astype(float), y[order].astype(float)
    robust, fitted = np.ones(n), np.zeros(n)
    left = np.zeros(n, dtype=np.int64)
    lo = 0
    for i in range(n):  # the window of nearest neighbours moves to the right only
        while lo + near < n and xs[lo + near] - xs[i] < xs[i] - xs[lo]:
            lo += 1
        left[i] = lo
    for round_ in range(rounds + 1):
        for i in range(n):
            span = slice(left[i], left[i] + near)
            d = np.abs(xs[span] - xs[i])
            reach = d.max()
            w = np.where(d < 0.999 * reach, (1 - (d / reach) ** 3) ** 3 if reach else 1.0, 0.0) if reach else np.ones(near)
            w = np.where(d <= 0.001 * reach, 1.0, w) * robust[span]
            total = w.sum()
            if total <= 0:
                fitted[i] = ys[i]
                continue
            w = w / total
            mean = (w * xs[span]).sum()
            spread = (w * (xs[span] - mean) ** 2).sum()
            if np.sqrt(spread) > 0.001 * (xs[-1] - xs[0]):
                w = w * (1 + (xs[i] - mean) * (xs[span] - mean) / spread)
            fitted[i] = (w * ys[span]).sum()
        if round_ == rounds:
            break
        off = np.abs(ys - fitted)
        scale = 6 * np.median(off)
        if scale <= 1e-9 * np.abs(ys).max():  # half of the points are fitted exactly
            break
        u = off / scale
        robust = np.where(u < 0.999, (1 - u**2) ** 2, 0.0)
        robust = np.where(u <= 0.001, 1.0, robust)
    out = np.empty(n)
    out[order] = fitted
    return out


def correct(counts: DataFrame, frac: float = 0.1, value: str = "n", gc: str = "gc", at_least: int = 10, clamp: bool = False) -> DataFrame:
    """``counts`` (sample_id, value, gc, ...) with the value divided by its fit on GC, times the sample's median.

    Samples with fewer than ``at_least`` bins that have both, or with no counts, stay
    as they are; elsewhere bins without a value or GC become null.  A group is one
    sample's bins.
    """
    kinds = ", ".join(f"`{f.name}` {'double' if f.name == value else f.dataType.simpleString()}" for f in counts.schema)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        y, x = group[value].to_numpy(dtype=float, na_value=np.nan), group[gc].to_numpy(dtype=float, na_value=np.nan)
        known = ~np.isnan(y) & ~np.isnan(x)
        if known.sum() >= at_least and np.nansum(y) > 0:
            fixed = np.full(len(y), np.nan)
            fit = lowess(y[known], x[known], frac)
            with np.errstate(divide="ignore", invalid="ignore"):
                fixed[known] = y[known] / fit * np.median(y[known])
            y = np.where(fixed < 0, 0.0, fixed) if clamp else fixed
        return group.assign(**{value: y})

    return counts.groupBy("sample_id").applyInPandas(one, kinds).withColumn(value, F.when(~F.isnan(value), F.col(value)))

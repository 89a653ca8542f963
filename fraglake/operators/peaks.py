"""Nucleosome calls: peaks of the protection score.

Runs make plateaus explicit: a peak is a run higher than both neighbours, its centre
the middle of the run.  Candidates come from window functions; the greedy choice by
distance and the prominence need a contig's runs in order, so they run as a grouped
Python function over runs (not bases), one group for each sample and contig.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def merge_runs(signal: DataFrame) -> DataFrame:
    """Adjacent runs of equal score joined, and stretches of score 0 between runs made explicit."""
    along = W.partitionBy("sample_id", "chrom").orderBy("p")
    gaps = signal.withColumn("q", F.lead("p").over(along)).where("q > p_end").select("sample_id", "chrom", F.col("p_end").alias("p"), F.col("q").alias("p_end"), F.lit(0).cast("long").alias("wps"))
    whole = signal.select("sample_id", "chrom", "p", "p_end", "wps").union(gaps)
    marked = whole.withColumn("fresh", F.coalesce((F.lag("wps").over(along) != F.col("wps")).cast("int"), F.lit(1)))
    numbered = marked.withColumn("run", F.sum("fresh").over(along.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("sample_id", "chrom", "run").agg(F.min("p").alias("p"), F.max("p_end").alias("p_end"), F.first("wps").alias("wps")).drop("run")


def candidates(signal: DataFrame) -> DataFrame:
    """sample_id, chrom, center, score: runs higher than both neighbours; the first and last run are none."""
    along = W.partitionBy("sample_id", "chrom").orderBy("p")
    seen = merge_runs(signal).withColumns({"left": F.lag("wps").over(along), "right": F.lead("wps").over(along)})
    peak = seen.where((F.col("left") < F.col("wps")) & (F.col("right") < F.col("wps")))
    return peak.select("sample_id", "chrom", F.floor((F.col("p") + F.col("p_end") - 1) / 2).alias("center"), F.col("wps").alias("score"))


def pick(starts: np.ndarray, ends: np.ndarray, values: np.ndarray, distance: int, prominence: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres and scores of the peaks of one signal of runs, in order."""
    n = len(values)
    if n < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    runs = np.flatnonzero((values[1:-1] > values[:-2]) & (values[1:-1] > values[2:])) + 1
    centers = (starts[runs] + ends[runs] - 1) // 2
    keep = np.ones(len(runs), dtype=bool)
    for i in np.argsort(values[runs], kind="stable")[::-1]:  # highest first, of equals the later
        if keep[i]:
            lo, hi = np.searchsorted(centers, centers[i] - distance, side="right"), np.searchsorted(centers, centers[i] + distance, side="left")
            keep[lo:hi] = False
            keep[i] = True
    runs, centers = runs[keep], centers[keep]
    # The lowest value on each side up to the next higher run, in one pass with a stack.
    low = {}
    for order, side in ((range(n), 0), (range(n - 1, -1, -1), 1)):
        stack: list[tuple[float, float]] = []  # (value, lowest since that run), values falling
        for r in order:
            least = values[r]
            while stack and stack[-1][0] <= values[r]:
                least = min(least, stack.pop()[1])
            low[side, r] = least
            stack.append((values[r], least))
    prominences = np.array([values[r] - max(low[0, r], low[1, r]) for r in runs])
    chosen = prominences >= prominence
    return centers[chosen], values[runs][chosen]


def call(signal: DataFrame, distance: int = 147, prominence: float = 5) -> DataFrame:
    """BED-like rows (sample_id, chrom, start, end, name, score, strand) of nucleosome centres."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("p")
        at, score = pick(group["p"].to_numpy(), group["p_end"].to_numpy(), group["wps"].to_numpy(dtype=float), distance, prominence)
        first = group.iloc[0]
        return pd.DataFrame({"sample_id": first["sample_id"], "chrom": first["chrom"], "start": at, "end": at + 1, "score": score})

    found = merge_runs(signal).groupBy("sample_id", "chrom").applyInPandas(one, "sample_id string, chrom string, start long, end long, score double")
    number = F.row_number().over(W.partitionBy("sample_id", "chrom").orderBy("start"))
    return found.select("sample_id", "chrom", "start", "end", F.concat(F.lit("nucleosome_"), F.col("chrom"), F.lit("_"), number.cast("string")).alias("name"), "score", F.lit(".").alias("strand"))


def bed_lines(calls: DataFrame, name: str = "name") -> DataFrame:
    """One text column of BED6 lines, in the order of samples and positions; the score has two decimals."""
    return calls.orderBy("sample_id", "chrom", "start").select(F.concat_ws("\t", "chrom", "start", "end", name, F.format_string("%.2f", "score"), "strand").alias("value"))


def check_region(start: int | None, end: int | None, length: int) -> tuple[int, int]:
    """The region, whole contig by default; raises if it isn't inside the contig."""
    start, end = start or 0, length if end is None else end
    if start < 0 or end <= start or end > length:
        raise ValueError(f"the region {start}-{end} isn't inside 0-{length}")
    return start, end

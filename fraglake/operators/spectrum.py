"""Strength of nucleosome-spaced periods in a gene's protection score.

Of the periodogram over a window of N bases only a few harmonics lie in the periods
asked for.  Each is two sums over the signal, and over a run of equal score these have
a closed form, so runs are never expanded to bases.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import overlap


def harmonics(width: int, low: float = 120, high: float = 280) -> list[int]:
    """Harmonics k whose period width / k is within the limits, longest period last."""
    return [k for k in range(width // 2, 0, -1) if low <= width / k <= high]


def needed(width: int, p_min: float, p_max: float) -> list[int]:
    """The harmonics next to and between the two periods."""
    known = sorted(harmonics(width), key=lambda k: width / k)
    if not known or not width / known[0] <= p_min <= p_max <= width / known[-1]:
        raise ValueError("the periods must be within the harmonics between 120 and 280 bases")
    below = max(i for i, k in enumerate(known) if width / k <= p_min)
    above = min(i for i, k in enumerate(known) if width / k >= p_max)
    return known[below : above + 1]


def _power(k: int, width: int) -> tuple[Column, Column]:
    """The sums of cosines and sines over a run [a, b) from the window's start, times its score."""
    w = 2 * math.pi * k / width
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    scale = F.col("wps") / (2 * math.sin(w / 2))
    cosine = scale * (F.sin(w * (b - 0.5)) - F.sin(w * (a - 0.5)))
    sine = scale * (F.cos(w * (a - 0.5)) - F.cos(w * (b - 0.5)))
    return cosine, sine


def gene_scores(signal: DataFrame, windows: DataFrame, width: int = 10_000, p_min: float = 193, p_max: float = 199, points: int = 100) -> DataFrame:
    """sample_id, gene, intensity: the mean, over ``points`` periods from p_min to p_max, of the interpolated power.

    A window without signal has intensity 0, for all samples that have any signal;
    ``signal`` holds runs of the protection score.  Where windows have a gene_id, genes
    are told apart by it, and the result has it (and ord) too: see :func:`by_name`.
    """
    keys = [c for c in ("gene_id", "ord", "gene") if c in windows.columns]
    ks = needed(width, p_min, p_max)
    parts = overlap.join(signal, windows, ("p", "p_end"), ("w_start", "w_end"), ["chrom"])
    parts = parts.withColumns({"a": F.greatest("p", "w_start") - F.col("w_start"), "b": F.least("p_end", "w_end") - F.col("w_start")})
    sums = []
    for k in ks:
        cosine, sine = _power(k, width)
        sums += [F.sum(cosine).alias(f"c{k}"), F.sum(sine).alias(f"s{k}")]
    powers = parts.groupBy("sample_id", *keys).agg(*sums)
    power = {k: 2 * (F.col(f"c{k}") ** 2 + F.col(f"s{k}") ** 2) / float(width) ** 2 for k in ks}
    weight = dict.fromkeys(ks, 0.0)
    for i in range(points):  # linear interpolation is a fixed weighted sum of the harmonics' powers
        period = p_min + (p_max - p_min) * i / (points - 1)
        j = next(j for j in range(len(ks) - 1) if period <= width / ks[j + 1] or j == len(ks) - 2)
        x0, x1 = width / ks[j], width / ks[j + 1]
        share = (period - x0) / (x1 - x0)
        weight[ks[j]] += (1 - share) / points
        weight[ks[j + 1]] += share / points
    total = sum((power[k] * w for k, w in weight.items()), F.lit(0.0))
    scored = powers.select("sample_id", *keys, total.alias("intensity"))
    # The dense result: each sample's one row is joined with all windows.
    one = F.lit(0).alias("__one")
    grid = signal.select("sample_id", one).distinct().join(windows.select(*keys, one).distinct(), "__one").drop("__one")
    return grid.join(scored, ["sample_id", *keys], "left").withColumn("intensity", F.coalesce("intensity", F.lit(0.0)))


def by_name(scores: DataFrame) -> DataFrame:
    """sample_id, gene, intensity: of genes of one name the one that stands last in the annotation."""
    return scores.groupBy("sample_id", "gene").agg(F.max_by("intensity", F.struct("ord", "gene_id")).alias("intensity"))

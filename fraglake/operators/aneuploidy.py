"""Trisomy likelihood ratios against a reference panel, and fetal fractions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def full_bins(panel: DataFrame, size: int = 1_000_000) -> DataFrame:
    """Panel rows (sample_id, chrom, bin_end, n) of whole bins on autosomes."""
    return panel.where((F.col("bin_end") % size == 0) & ~F.col("chrom").rlike("^chr[MXY]"))


def depth_filter(panel: DataFrame, low: float = 5e6, high: float = 50e6) -> DataFrame:
    """Samples whose total lies strictly between the limits."""
    total = F.sum("n").over(W.partitionBy("sample_id"))
    return panel.withColumn("__total", total).where((F.col("__total") > low) & (F.col("__total") < high)).drop("__total")


def shares(counts: DataFrame) -> DataFrame:
    """sample_id, chrom, bin, x: each bin's share of the sample."""
    total = F.sum("n").over(W.partitionBy("sample_id"))
    return counts.select("sample_id", "chrom", "bin", F.try_divide(F.col("n").cast("double"), total.cast("double")).alias("x"))


def panel_statistics(panel_shares: DataFrame) -> DataFrame:
    """chrom, bin, m, sd over the panel's samples; a row a bin, whatever the panel's size."""
    return panel_shares.groupBy("chrom", "bin").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"))


def _log_density(x: Column, mean: Column, sd: Column) -> Column:
    return -0.5 * F.pow((x - mean) / sd, F.lit(2.0)) - F.ln(sd) - 0.5 * math.log(2 * math.pi)


def missing_bins(sample_shares: DataFrame, wanted: DataFrame) -> DataFrame:
    """sample_id, n_missing: how many of the bins in ``wanted`` (chrom, bin) a sample lacks; a row a sample."""
    have = sample_shares.join(wanted.select("chrom", "bin"), ["chrom", "bin"], "left_semi").groupBy("sample_id").agg(F.count("*").alias("n"))
    samples = sample_shares.select("sample_id").distinct().join(have, "sample_id", "left")
    total = wanted.agg(F.count("*").alias("total")).withColumn("__one", F.lit(0))
    counted = samples.withColumn("__one", F.lit(0)).join(F.broadcast(total), "__one")  # one number
    return counted.select("sample_id", (F.col("total") - F.coalesce("n", F.lit(0))).alias("n_missing"))


def complete(sample_shares: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sample_shares``; a sample that lacks a bin of ``wanted`` makes the job fail, since its ratio would shift silently."""
    text = F.concat(F.lit("sample "), F.col("sample_id"), F.lit(" lacks "), F.col("n_missing").cast("string"), F.lit(" bins"))
    checked = missing_bins(sample_shares, wanted).withColumn("ok", F.when(F.col("n_missing") > 0, F.raise_error(text)).otherwise(F.lit(None).cast("string")).isNull())
    return sample_shares.join(checked.where("ok").select("sample_id"), "sample_id", "left_semi")


def trisomy_ratio(sample_shares: DataFrame, panel: DataFrame, ff: float = 0.10, target: str = "chr21") -> DataFrame:
    """sample_id, llr, ff, and, where the ratio is positive, llr_updated, ff_inferred and their ratio; else nulls.

    ``panel`` is :func:`panel_statistics`.  Under the alternative the target's means
    grow by ff / 2 of themselves and all are scaled to sum to 1.  Samples must have all
    bins of the panel.
    """
    joined = complete(sample_shares, panel).join(panel, ["chrom", "bin"])
    on_target = F.col("chrom").startswith(target)
    per_sample = W.partitionBy("sample_id")

    def ratio(df: DataFrame, fraction: Column, name: str) -> DataFrame:
        grown = F.when(on_target, F.col("m") * (1 + fraction / 2)).otherwise(F.col("m"))
        scaled = df.withColumn("__alt", grown).withColumn("__alt", F.col("__alt") / F.sum("__alt").over(per_sample))
        return scaled.withColumn(name, _log_density(F.col("x"), F.col("__alt"), F.col("sd")) - _log_density(F.col("x"), F.col("m"), F.col("sd")))

    first = ratio(joined, F.lit(ff), "__d1")
    # mean over target bins of 2 * mean(x - m) / m
    off = F.avg(F.when(on_target, F.col("x") - F.col("m"))).over(per_sample) * 2
    inferred = first.withColumn("__ff", off * F.avg(F.when(on_target, 1 / F.col("m"))).over(per_sample))
    second = ratio(inferred, F.col("__ff"), "__d2")
    sums = second.groupBy("sample_id").agg((2 * F.sum("__d1")).alias("llr"), (2 * F.sum("__d2")).alias("again"), F.first("__ff").alias("inferred"))
    positive = F.col("llr") > 0
    return sums.select(
        "sample_id", "llr", F.lit(float(ff)).alias("ff"), F.when(positive, F.col("again")).alias("llr_updated"), F.when(positive, F.col("inferred")).alias("ff_inferred"), F.when(positive, F.col("inferred") / F.lit(float(ff))).alias("ratio")
    )


def fetal_fraction(bin_shares: DataFrame, coefficients: DataFrame, intercept: float = 0.0) -> DataFrame:
    """sample_id, ff: a linear predictor over bins' shares; coefficients are (chrom, bin, coef), one a bin, of which a sample must have all."""
    joined = complete(bin_shares, coefficients).join(coefficients, ["chrom", "bin"])
    return joined.groupBy("sample_id").agg((F.sum(F.col("x") * F.col("coef")) + F.lit(intercept)).alias("ff"))

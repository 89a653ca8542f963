"""Genomic bins: counts, and ratios of short to long fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from . import dense, reads

Contigs = list[tuple[str, int]]


def vocabulary(contigs: Contigs, size: int) -> Column:
    """Array of structs (ord, chrom, bin, bin_start, bin_end, label), in contig order.

    A contig has length div size + 1 bins, the last cut at its end; where the length
    is a multiple of the size the last one is empty.
    """
    return F.concat(*(_bins(k, chrom, length, size) for k, (chrom, length) in enumerate(contigs)))


def _bins(order: int, chrom: str, length: int, size: int) -> Column:
    def one(b: Column) -> Column:
        start, end = b * F.lit(size).cast("long"), F.least((b + 1) * F.lit(size).cast("long"), F.lit(length).cast("long"))
        label = F.concat_ws("_", F.lit(chrom), start.cast("string"), end.cast("string"))
        return F.struct(F.lit(order).alias("ord"), F.lit(chrom).alias("chrom"), b.alias("bin"), start.alias("bin_start"), end.alias("bin_end"), label.alias("label"))

    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(length // size).cast("long")), one)


def labels(contigs: Contigs, size: int) -> list[str]:
    """The labels of all bins, in order, as Python strings for column names."""
    return [f"{c}_{b * size}_{min((b + 1) * size, n)}" for c, n in contigs for b in range(n // size + 1)]


def bin_of(size: int) -> Column:
    return F.floor(F.col("reference_start") / F.lit(size)).cast("long")


def counts(df: DataFrame, size: int, require: int | None = None, exclude: int = S.EXCLUDED, mapq: int = 60) -> DataFrame:
    """sample_id, chrom, bin, n; duplicates and unmapped reads never count."""
    chosen = df.where(reads.kept(require, exclude, mapq) & reads.lacks(S.DUPLICATE | S.UNMAPPED))
    return chosen.groupBy("sample_id", "chrom", bin_of(size).alias("bin")).agg(F.count("*").alias("n"))


def dense_counts(df: DataFrame, contigs: Contigs, size: int, how: str = "counts", per: float = 1e6, **filters) -> DataFrame:
    """sample_id, ord, chrom, bin, bin_start, bin_end, label, n: every bin of every sample."""
    grid = df.select("sample_id").distinct().select("sample_id", F.inline(vocabulary(contigs, size)))
    filled = grid.join(counts(df, size, **filters), ["sample_id", "chrom", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return dense.normalise(filled, how, per=per)


def short_long(df: DataFrame, contigs: Contigs, size: int, short: tuple[int, int] = (100, 150), long: tuple[int, int] = (150, 200), use_insert: bool = True, mapq: int = 60, exclude: int = 0) -> DataFrame:
    """Bins with n_short, n_long and ratio (short + 1) / (long + 1); all four limits are exclusive.

    With insert sizes only second reads count, once a fragment.
    """
    length = reads.fragment_size(use_insert)
    chosen = df.where(reads.kept(None, exclude, mapq) & reads.lacks(S.DUPLICATE | S.UNMAPPED))
    if use_insert:
        chosen = chosen.where(reads.has(S.READ2))
    is_short = (length > short[0]) & (length < short[1])
    is_long = (length > long[0]) & (length < long[1]) & ~is_short
    found = chosen.groupBy("sample_id", "chrom", bin_of(size).alias("bin")).agg(F.count_if(is_short).alias("n_short"), F.count_if(is_long).alias("n_long"))
    grid = df.select("sample_id").distinct().select("sample_id", F.inline(vocabulary(contigs, size)))
    filled = grid.join(found, ["sample_id", "chrom", "bin"], "left").fillna(0, ["n_short", "n_long"])
    return filled.withColumn("ratio", (F.col("n_short") + 1) / (F.col("n_long") + 1))


def parse_label(label: Column | str) -> Column:
    """Struct (chrom, bin_start, bin_end) of a label like chr1_0_1000; null where it isn't one."""
    parts = F.split(label, "_")
    n = F.size(parts)
    chrom = F.when(n == 3, parts[0]).when(n == 4, F.concat_ws("_", parts[0], parts[1]))
    start, end = F.try_element_at(parts, F.lit(-2)).try_cast("long"), F.try_element_at(parts, F.lit(-1)).try_cast("long")
    return F.when(chrom.isNotNull() & start.isNotNull() & end.isNotNull(), F.struct(chrom.alias("chrom"), start.alias("bin_start"), end.alias("bin_end")))

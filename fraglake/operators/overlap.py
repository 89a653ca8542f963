"""Interval overlap as an equi-join on bins with a residual range filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], keys: list[str], bin_size: int = 10_000) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose half-open ranges overlap, each pair once.

    Each row goes to the bins that it touches; a pair that shares several bins is
    reported by the first of them (where the later of the two ranges begins).
    """

    def binned(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        first, last = (F.floor(x / F.lit(bin_size)).cast("long") for x in (F.col(span[0]), F.col(span[1]) - 1))
        return df.where(F.col(span[1]) > F.col(span[0])).withColumn("__bin", F.explode(F.sequence(first, last)))

    pairs = binned(left, left_range).join(binned(right, right_range), [*keys, "__bin"])
    later = F.greatest(left_range[0], right_range[0])
    meet = (F.col(left_range[0]) < F.col(right_range[1])) & (F.col(right_range[0]) < F.col(left_range[1]))
    return pairs.where(meet & (F.floor(later / F.lit(bin_size)) == F.col("__bin"))).drop("__bin")


def gene_windows(genes: DataFrame, width: int = 10_000) -> DataFrame:
    """gene (and gene_id and ord, where ``genes`` has them), chrom, w_start, w_end: ``width`` bases from the gene's start in its own direction."""
    forward = F.col("strand") == "+"
    start = F.when(forward, F.col("start")).otherwise(F.col("end") - width)
    return genes.select(*(c for c in ("gene_id", "ord") if c in genes.columns), "gene", "chrom", start.alias("w_start"), (start + width).alias("w_end"))


def reconcile_contigs(genes: DataFrame, contigs: DataFrame) -> DataFrame:
    """``genes`` with contig names as the reads have them: as they are, else with chr before; others are dropped."""
    names = contigs.select(F.col("chrom").alias("__have"))
    named = genes.withColumn("__try", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("chrom").alias("c")), F.struct(F.lit(1).alias("o"), F.concat(F.lit("chr"), "chrom").alias("c")))))
    hits = named.join(F.broadcast(names), F.col("__try.c") == F.col("__have"))
    columns = [c for c in genes.columns if c != "chrom"]
    return hits.groupBy(*columns, "chrom").agg(F.min("__try").alias("best")).select(*columns, F.col("best.c").alias("chrom"))

"""Filters over aligned reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S


def has(bits: int) -> Column:
    """All of ``bits`` are set."""
    return F.col("flag").bitwiseAND(F.lit(bits)) == bits


def lacks(bits: int) -> Column:
    """None of ``bits`` is set."""
    return F.col("flag").bitwiseAND(F.lit(bits)) == 0


def is_reverse() -> Column:
    return has(S.REVERSE)


def kept(require: int | None = None, exclude: int = S.EXCLUDED, mapq: int = 60) -> Column:
    """The flag and quality filter that the extractors share; ``exclude=0`` excludes nothing.

    The quality bound reaches the Parquet scan; the bit tests run right after it.
    """
    keep = F.col("mapq") >= mapq
    if require is not None:
        keep = keep & has(require)
    return keep & lacks(exclude) if exclude else keep


def mapped_counts(reads: DataFrame) -> DataFrame:
    """sample_id and its number of mapped reads."""
    return reads.groupBy("sample_id").agg(F.count_if(lacks(S.UNMAPPED)).alias("mapped"))


#: Samples whose totals, of about 100 bytes each, are broadcast.
BROADCAST_SAMPLES = 100_000


def _with_totals(reads: DataFrame) -> DataFrame:
    """``reads`` with their sample's number of mapped reads; the totals are counted first, and reads aren't moved unless there are very many samples."""
    totals = mapped_counts(reads)
    rows = totals.limit(BROADCAST_SAMPLES + 1).collect()
    if len(rows) <= BROADCAST_SAMPLES:
        totals = F.broadcast(reads.sparkSession.createDataFrame(rows, totals.schema))
    return reads.join(totals, "sample_id")


def subsample(reads: DataFrame, at_most: int, key: Column | str = "qname", seed: int = 42) -> DataFrame:
    """About ``at_most`` reads of each sample, chosen by a hash of ``key``: the same for any partitioning.

    Reads of equal key, such as mates, are kept or dropped together.
    """
    share = F.least(F.lit(1.0), F.lit(float(at_most)) / F.greatest(F.col("mapped"), F.lit(1)))
    drawn = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return _with_totals(reads).where(drawn <= share).drop("mapped")


def subsample_by_digest(reads: DataFrame, at_most: int, key: Column) -> DataFrame:
    """As :func:`subsample`, by the MD5 digest of ``key``, which other engines have too."""
    share = F.least(F.lit(1.0), F.lit(float(at_most)) / F.greatest(F.col("mapped"), F.lit(1)))
    drawn = F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28))
    return _with_totals(reads).where(drawn <= share).drop("mapped")


def fragment_size(use_insert: bool = True) -> Column:
    """The template's absolute length, or the read's own length."""
    return F.abs("template_length") if use_insert else F.col("query_length").cast("long")


def fragments(reads: DataFrame, min_size: int = 120, max_size: int = 180, corrected: bool = False) -> DataFrame:
    """Fragments (sample_id, chrom, frag_start, frag_end) from first reads of proper pairs, sizes inclusive.

    For a negative template length the fragment ends where the read starts; with
    ``corrected``, where the read ends.
    """
    size = F.abs("template_length")
    end = F.col("reference_end") if corrected else F.col("reference_start")
    start = F.when(F.col("template_length") > 0, F.col("reference_start")).otherwise(end - size)
    chosen = reads.where(has(S.PAIRED | S.PROPER | S.READ1) & size.between(min_size, max_size))
    return chosen.select("sample_id", "chrom", start.alias("frag_start"), (start + size).alias("frag_end"))

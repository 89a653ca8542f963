"""Fragment size histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from . import dense, reads


def histogram(df: DataFrame, lower: int = 60, upper: int = 1000, use_insert: bool = True, require: int | None = None, exclude: int = S.EXCLUDED, mapq: int = 60) -> DataFrame:
    """sample_id, size, n for sizes from ``lower`` to ``upper`` - 1.

    By insert, second reads of pairs that face different ways count, once a
    fragment; else all reads by their own length.
    """
    chosen = df.where(reads.kept(require, exclude, mapq))
    if use_insert:
        facing = reads.has(S.REVERSE) != reads.has(S.MATE_REVERSE)
        chosen = chosen.where(reads.has(S.READ2) & facing)
    size = reads.fragment_size(use_insert)
    return chosen.where((size >= lower) & (size < upper)).groupBy("sample_id", size.alias("size")).agg(F.count("*").alias("n"))


def zero_filled(df: DataFrame, lower: int = 60, upper: int = 1000, how: str = "counts", per: float = 1e6, **filters) -> DataFrame:
    """Every size of every sample, normalised."""
    vocabulary = F.sequence(F.lit(lower).cast("long"), F.lit(upper - 1).cast("long"))
    return dense.normalise(dense.fill(histogram(df, lower, upper, **filters), df, vocabulary, "size"), how, per=per)

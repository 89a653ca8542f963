"""Reference sequences as fixed-size tiles, and ranges fetched from them.

A tile is (chrom, tile, seq) with ``size`` bases.  A range of at most ``size`` bases
is cut from its tile and the next, which are joined once, by an equi-join on the tile
number; there is no range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence


def doubled(tiles: DataFrame) -> DataFrame:
    """Each tile followed by the next one of its contig (chrom, tile, seq2)."""
    following = tiles.select("chrom", (F.col("tile") - 1).alias("tile"), F.col("seq").alias("next_seq"))
    return tiles.join(following, ["chrom", "tile"], "left").select("chrom", "tile", F.concat("seq", F.coalesce("next_seq", F.lit(""))).alias("seq2"))


def fetch(rows: DataFrame, tiles: DataFrame, start: Column, length: int, size: int, name: str = "motif") -> DataFrame:
    """``rows`` with the bases from ``start`` (0-based) on; rows whose tile doesn't exist are dropped."""
    if length > size:
        raise ValueError(f"a range may have at most {size} bases")
    placed = rows.withColumns({"__at": start, "tile": F.floor(start / F.lit(size)).cast("long")})
    found = placed.join(doubled(tiles), ["chrom", "tile"])
    cut = F.substring("seq2", (F.col("__at") % size + 1).cast("int"), F.lit(length))
    return found.withColumn(name, cut).drop("__at", "tile", "seq2")


def composition(tiles: DataFrame, bins: DataFrame, size: int, letters: str = "GC", name: str = "gc") -> DataFrame:
    """Share of ``letters`` among all bases of each bin (chrom, bin, bin_start, bin_end); N counts as a base; no bases: null.

    A bin is exploded into the tiles it touches; each contributes the part inside it.
    """
    touched = bins.where("bin_end > bin_start").select("chrom", "bin", "bin_start", "bin_end", F.explode(F.sequence(F.floor(F.col("bin_start") / size).cast("long"), F.floor((F.col("bin_end") - 1) / size).cast("long"))).alias("tile"))
    first = F.greatest(F.lit(0).cast("long"), F.col("bin_start") - F.col("tile") * size)
    last = F.least(F.lit(size).cast("long"), F.col("bin_end") - F.col("tile") * size)
    part = F.substring("seq", (first + 1).cast("int"), (last - first).cast("int"))
    sums = touched.join(tiles, ["chrom", "tile"]).groupBy("chrom", "bin").agg(F.sum(sequence.count_letters(part, letters)).alias("hits"), F.sum(F.length(part)).alias("bases"))
    shares = sums.select("chrom", "bin", F.try_divide(F.col("hits").cast("double"), F.col("bases").cast("double")).alias(name))
    return bins.select("chrom", "bin").join(shares, ["chrom", "bin"], "left")


def contigs_of(tiles: DataFrame) -> DataFrame:
    """chrom and its length."""
    return tiles.groupBy("chrom").agg(F.sum(F.length("seq")).cast("long").alias("length"))

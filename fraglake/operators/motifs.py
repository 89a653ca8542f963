"""End motifs: at the cut site in the reference, or at the 5' end of the read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import sequence as seq
from . import dense, reads, tiles


def _named(counted: DataFrame, k: int, canonical: bool, purpyr: bool) -> DataFrame:
    """Counts (sample_id, motif, (size,) n) of raw motifs, as at most a few hundred of each sample and size, by their names."""
    keys = ["sample_id", "motif", *(["size"] if "size" in counted.columns else [])]
    raw = counted.groupBy(*keys).agg(F.sum("n").alias("n")).where(seq.is_concrete("motif"))
    motif: Column = seq.purine_pyrimidine("motif") if purpyr else F.col("motif")
    return raw.withColumn("motif", seq.canonical(motif) if canonical or purpyr else motif).groupBy(*keys).agg(F.sum("n").alias("n"))


#: Contigs whose lengths, of about 100 bytes each, are broadcast.
BROADCAST_CONTIGS = 100_000


def _with_lengths(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """``df`` with its contig's length; the contigs, of which a genome has few, go to the reads, which aren't moved unless there are very many contigs."""
    rows = contigs.limit(BROADCAST_CONTIGS + 1).collect()
    if len(rows) <= BROADCAST_CONTIGS:
        contigs = F.broadcast(contigs.sparkSession.createDataFrame(rows, contigs.schema))
    return df.join(contigs, "chrom")


def cut_site(df: DataFrame, tiled: DataFrame, contigs: DataFrame, k: int = 4, tile_size: int = 32, purpyr: bool = False, by_size: tuple[int, int] | None = None, use_insert: bool = True, require: int | None = None, exclude: int = S.EXCLUDED, mapq: int = 60) -> DataFrame:
    """sample_id, motif, (size,) n: the k bases around each read's 5' end in the reference, as canonical k-mers.

    For odd k the extra base stands on the left.  Reads closer than k / 2 to a
    contig's end, and motifs with other letters than A, C, G, T, don't count.
    """
    half = k // 2
    placed = _with_lengths(df.where(reads.kept(require, exclude, mapq)), contigs)
    placed = placed.where((F.col("reference_start") > half) & (F.col("reference_end") < F.col("length") - half)).drop("length")
    cut = F.when(reads.is_reverse(), F.col("reference_end")).otherwise(F.col("reference_start"))
    # Reads that cut at one place are counted before they meet the reference.
    size = [] if by_size is None else [reads.fragment_size(use_insert).alias("size")]
    if by_size is not None:
        placed = placed.where((reads.fragment_size(use_insert) >= by_size[0]) & (reads.fragment_size(use_insert) < by_size[1]))
    places = placed.groupBy("sample_id", "chrom", cut.alias("cut"), *size).agg(F.count("*").alias("n"))
    found = tiles.fetch(places, tiled, F.col("cut") - (k + 1) // 2, k, tile_size, "motif").withColumn("motif", F.upper("motif"))
    return _named(found, k, True, purpyr)


def five_prime(df: DataFrame, k: int = 4, canonical: bool = False, purpyr: bool = False, tiled: DataFrame | None = None, tile_size: int = 32, by_size: tuple[int, int] | None = None, use_insert: bool = True, require: int | None = None, exclude: int = S.EXCLUDED, mapq: int = 60) -> DataFrame:
    """sample_id, motif, (size,) n: the first k bases of each read in its own direction.

    They come from the read, or, with ``tiled``, from the reference at its place.
    Reads of up to 2 k bases, duplicates and motifs with other letters don't count.
    """
    chosen = df.where(reads.kept(require, exclude, mapq) & reads.lacks(S.DUPLICATE) & (F.length("query_sequence") > 2 * k))
    if tiled is None:
        chosen = chosen.withColumn("motif", F.when(reads.is_reverse(), seq.revcomp(F.right("query_sequence", F.lit(k)))).otherwise(F.substring("query_sequence", 1, k)))
    else:
        at = F.when(reads.is_reverse(), F.col("reference_end") - k).otherwise(F.col("reference_start"))
        chosen = tiles.fetch(chosen, tiled, at, k, tile_size, "motif")
        chosen = chosen.withColumn("motif", F.when(reads.is_reverse(), seq.revcomp("motif")).otherwise(F.col("motif")))
    keys = [F.col("sample_id"), F.upper("motif").alias("motif")]
    if by_size is not None:
        size = reads.fragment_size(use_insert)
        chosen = chosen.where((size >= by_size[0]) & (size < by_size[1]))
        keys.append(size.alias("size"))
    return _named(chosen.groupBy(*keys).agg(F.count("*").alias("n")), k, canonical, purpyr)


def zero_filled(counts: DataFrame, samples: DataFrame, k: int = 4, canonical: bool = True, purpyr: bool = False, how: str = "counts", per: float = 1e6) -> DataFrame:
    """Counts over the whole vocabulary, normalised; 136 canonical 4-mers of 256, 10 of 16 in purines and pyrimidines."""
    vocabulary = seq.kmers(k, "RY" if purpyr else "ACGT", canonical or purpyr)
    return dense.normalise(dense.fill(counts, samples, vocabulary, "motif"), how, per=per)

"""Windowed protection scores as run-length-encoded signals.

At a position, the score is the number of fragments that span the window around it
less the number of fragment ends inside the window.  Each fragment is turned into at
most six steps (position, change); summed by position and accumulated along the
contig they give the signal as runs, so the work follows the fragments, not the bases.

The accumulation has two levels: running sums inside blocks of ``BLOCK`` bases, and
running sums of the blocks' totals, so that a long contig isn't one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BLOCK = 1 << 20


def steps(fragments: DataFrame, k: int = 120) -> DataFrame:
    """sample_id, chrom, p, d: where the score changes, by how much."""
    h, start, end = k // 2, F.col("frag_start"), F.col("frag_end")

    def step(p, d):
        return F.struct(p.alias("p"), F.lit(d).cast("long").alias("d"))

    spanning = F.array(step(start + h, 1), step(end - h + 1, -1))
    ends = F.array(step(start - h + 1, -1), step(start + h + 1, 1))
    other = F.array(step(end - h, -1), step(end + h, 1))
    nothing = F.array().cast("array<struct<p: bigint, d: bigint>>")
    all_ = F.concat(F.when(end - h >= start + h, spanning).otherwise(nothing), ends, F.when(end - 1 != start, other).otherwise(nothing))
    changes = fragments.select("sample_id", "chrom", F.inline(all_))
    return changes.groupBy("sample_id", "chrom", "p").agg(F.sum("d").alias("d")).where("d <> 0")


def runs(changes: DataFrame, block: int = BLOCK) -> DataFrame:
    """sample_id, chrom, p, p_end, wps: runs of equal score; the stretch after the last change, of score 0, is left out."""
    blocked = changes.withColumn("block", F.floor(F.col("p") / F.lit(block)).cast("long"))
    totals = blocked.groupBy("sample_id", "chrom", "block").agg(F.sum("d").alias("t"), F.min("p").alias("first"))
    along = W.partitionBy("sample_id", "chrom").orderBy("block")
    before = totals.select("sample_id", "chrom", "block", (F.sum("t").over(along.rowsBetween(W.unboundedPreceding, 0)) - F.col("t")).alias("before"), F.lead("first").over(along).alias("next_first"))
    inside = W.partitionBy("sample_id", "chrom", "block").orderBy("p")
    local = blocked.withColumns({"s": F.sum("d").over(inside.rowsBetween(W.unboundedPreceding, 0)), "p_next": F.lead("p").over(inside)})
    joined = local.join(before, ["sample_id", "chrom", "block"])
    signal = joined.select("sample_id", "chrom", "p", F.coalesce("p_next", "next_first").alias("p_end"), (F.col("s") + F.col("before")).alias("wps"))
    return signal.where(F.col("p_end").isNotNull())


def clip(signal: DataFrame, start: int, end: int) -> DataFrame:
    """The part of the runs inside [start, end)."""
    inside = signal.where((F.col("p_end") > start) & (F.col("p") < end))
    return inside.withColumns({"p": F.greatest("p", F.lit(start).cast("long")), "p_end": F.least("p_end", F.lit(end).cast("long"))})


def densify(signal: DataFrame) -> DataFrame:
    """A row a base: sample_id, chrom, pos, wps."""
    return signal.select("sample_id", "chrom", F.explode(F.sequence("p", F.col("p_end") - 1)).alias("pos"), "wps")

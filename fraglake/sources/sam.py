"""SAM text, split by Spark like any text; and path lists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def reference_span(cigar):
    """Bases of the reference that a CIGAR covers (M, D, N, =, X)."""
    runs = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), 1)
    return F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Reads of SAM files in the library's schema; the sample is the file's path (without file: before it, as for BAM); starts are 0-based."""
    lines = spark.read.text(paths).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "").alias("sample_id"), F.split("value", "\t").alias("f")).where(~F.col("value").startswith("@"))
    col = {n: F.get("f", F.lit(i)) for i, n in enumerate(FIELDS)}
    start = col["pos"].try_cast("long") - 1  # header lines may be evaluated before they are filtered out
    seq = F.when(col["seq"] != "*", col["seq"])
    return lines.where(F.size("f") >= len(FIELDS)).select(
        "sample_id",
        col["qname"].alias("qname"),
        col["flag"].try_cast("int").alias("flag"),
        F.when(col["rname"] != "*", col["rname"]).alias("chrom"),
        start.alias("reference_start"),
        (start + reference_span(col["cigar"])).alias("reference_end"),
        col["mapq"].try_cast("int").alias("mapq"),
        col["cigar"].alias("cigar"),
        col["tlen"].try_cast("long").alias("template_length"),
        F.coalesce(F.length(seq), F.lit(0)).alias("query_length"),
        seq.alias("query_sequence"),
    )


def contigs(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and lengths from the header's @SQ lines, in order (one header, a few thousand lines)."""
    rows = spark.read.text(path).where(F.col("value").startswith("@SQ")).collect()
    found = []
    for r in rows:
        fields = dict(f.split(":", 1) for f in r["value"].split("\t")[1:] if ":" in f)
        found.append((fields["SN"], int(fields["LN"])))
    return found


def path_list(spark: SparkSession, path: str) -> list[str]:
    """One path a line; blank lines are skipped."""
    return [line for r in spark.read.text(path).collect() if (line := re.sub(r"\s+$", "", r["value"]))]

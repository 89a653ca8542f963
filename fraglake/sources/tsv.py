"""Tables of text: TSV files, gzip or not, and base64 data URLs."""

from __future__ import annotations

import base64
import gzip
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that stand for a missing value: fixed values.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text, missing ones null; gzip by the file's extension."""
    rows = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).csv(path)
    return rows.select(*(F.when(~F.trim(F.col(f"`{c}`")).isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in rows.columns))


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines without the header."""
    return max(0, spark.read.text(path).count() - 1)


def maybe_gunzip(raw: bytes) -> bytes:
    """Decompressed once if it begins like gzip."""
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def decode_data_url(text: str) -> bytes:
    """The content of a base64 data URL, with or without its prefix, white space and padding."""
    body = re.sub(r"\s+", "", text.split(",", 1)[1] if text.startswith("data:") and "," in text else text)
    return maybe_gunzip(base64.b64decode(body + "=" * (-len(body) % 4)))


def panel(spark: SparkSession, path: str) -> DataFrame:
    """A reference panel (first column the sample, others bins named chrom_start_end) as rows sample_id, chrom, bin_start, bin_end, n."""
    from ..operators import bins

    wide = spark.read.option("sep", "\t").option("header", True).csv(path)
    first, rest = wide.columns[0], wide.columns[1:]
    long = wide.select(F.col(f"`{first}`").alias("sample_id"), *(F.col(f"`{c}`").try_cast("double").alias(c) for c in rest)).unpivot("sample_id", rest, "label", "n")
    return long.withColumn("b", bins.parse_label("label")).where("b is not null").select("sample_id", "b.*", "n")

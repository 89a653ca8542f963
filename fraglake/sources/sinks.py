"""Tables as TSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    """One folder of TSV parts, in parallel; arrays aren't supported, so widen first."""
    df.write.mode("overwrite").option("sep", "\t").option("header", header).csv(path)


def wide_rows(counts: DataFrame, key: str, keys: list[str], value: str = "n", name: bool = True) -> DataFrame:
    """A row a sample, a column an entry of the vocabulary, with or without the sample's name."""
    wide = counts.groupBy("sample_id").pivot(key, keys).agg(F.first(value))
    return wide.withColumnRenamed("sample_id", "filename") if name else wide.drop("sample_id")


def size_matrix(counts: DataFrame, lower: int, upper: int, motifs: list[str] | None = None) -> DataFrame:
    """Rows by sample and motif, a column for each size; zero where nothing was counted.

    With ``motifs`` each sample has a row for each of them, seen or not.
    """
    if motifs is not None:
        grid = counts.select("sample_id").distinct().select("sample_id", F.explode(F.array(*map(F.lit, motifs))).alias("motif"))
        counts = grid.join(counts, ["sample_id", "motif"], "left")
    return counts.groupBy("sample_id", "motif").pivot("size", list(range(lower, upper))).agg(F.first("n")).fillna(0)

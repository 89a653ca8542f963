"""Zero-filled counts over a vocabulary, and their normal forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def fill(counts: DataFrame, samples: DataFrame, vocabulary: Column, key: str, value: str = "n") -> DataFrame:
    """``counts`` (sample_id, key, value) with a row for each sample and entry of ``vocabulary``; entries outside it are dropped.

    The vocabulary is an array expression that each sample's one row is exploded
    by, so the zero-filled result, of just its own size, is made without a join of
    tables; the counts, aggregated before, are joined to it on both keys.
    """
    grid = samples.select("sample_id").distinct().select("sample_id", F.explode(vocabulary).alias(key))
    return grid.join(counts.select("sample_id", key, value), ["sample_id", key], "left").withColumn(value, F.coalesce(value, F.lit(0).cast("long")))


def normalise(counts: DataFrame, how: str = "counts", value: str = "n", per: float = 1e6) -> DataFrame:
    """``counts``: as they are; ``freq``: shares of the sample's sum; ``rpx``: reads per ``per``, truncated.

    A sample without any count has shares of null and reads per x of zero.
    """
    if how == "counts":
        return counts
    total = F.sum(value).over(W.partitionBy("sample_id"))
    if how == "freq":
        return counts.withColumn(value, F.try_divide(F.col(value).cast("double"), total.cast("double")))
    if how == "rpx":
        scaled = F.try_divide(F.col(value).cast("double"), total.cast("double") / F.lit(float(per)))
        return counts.withColumn(value, F.coalesce(F.floor(scaled), F.lit(0)).cast("long"))
    raise ValueError(f"unknown norm {how!r}; use counts, freq or rpx")


def depth_flag(counts: DataFrame, per: float = 1e6, value: str = "n") -> DataFrame:
    """sample_id, its total and whether that is below the unit it is normalised to."""
    return counts.groupBy("sample_id").agg(F.sum(value).alias("total")).withColumn("shallow", F.col("total") < per)


def widen(counts: DataFrame, key: str, keys: list[str], value: str = "n") -> DataFrame:
    """A row a sample, a column a key; the columns are given, so no pass looks for them."""
    return counts.groupBy("sample_id").pivot(key, keys).agg(F.first(value))

"""The explorer's queries: histograms, colours, bands, z-score tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import numbers

#: Lengths of the human reference's (GRCh38) chromosomes, in order: fixed values.
CHROMOSOMES = {
    "chr1": 248956422, "chr2": 242193529, "chr3": 198295559, "chr4": 190214555, "chr5": 181538259, "chr6": 170805979, "chr7": 159345973, "chr8": 145138636,
    "chr9": 138394717, "chr10": 133797422, "chr11": 135086622, "chr12": 133275309, "chr13": 114364328, "chr14": 107043718, "chr15": 101991189, "chr16": 90338345,
    "chr17": 83257441, "chr18": 80373285, "chr19": 58617616, "chr20": 64444167, "chr21": 46709983, "chr22": 50818468, "chrX": 156040895, "chrY": 57227415,
}


def _number(df: DataFrame, column: str) -> Column:
    text = F.col(f"`{column}`")
    return numbers.number(text) if dict(df.dtypes)[column] == "string" else text.try_cast("double")


def histogram(df: DataFrame, value: str, low: float, high: float, n: int) -> DataFrame:
    """bucket (1 to n; 0 and n + 1: outside), count."""
    bucket = F.width_bucket(F.col(value), F.lit(float(low)), F.lit(float(high)), F.lit(n))
    return df.where(F.col(value).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def histogram_by_colour(df: DataFrame, value: str, colour: str, low: float, high: float, n: int) -> DataFrame:
    """colour, bucket, share of the colour's rows."""
    bucket = F.width_bucket(F.col(value), F.lit(float(low)), F.lit(float(high)), F.lit(n))
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(colour).alias("colour"), bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("colour"))).drop("n")


def quantile_edges(df: DataFrame, value: str, q: int) -> list[float]:
    """Distinct edges of q equally likely bins, by linear interpolation."""
    if not 2 <= q <= 10:
        raise ValueError("between 2 and 10 bins")
    row = df.agg(F.percentile(value, F.array(*(F.lit(i / q) for i in range(q + 1)))).alias("e")).first()
    return sorted(set(row["e"] or []))


def quantile_bin(df: DataFrame, value: str, q: int) -> DataFrame:
    """``df`` with qbin from 0 on: right-closed bins, the lowest edge included; fewer than q where edges coincide; missing: null."""
    edges = quantile_edges(df, value, q)
    if len(edges) < 2:
        return df.withColumn("qbin", F.lit(None).cast("int"))
    above = sum((F.when(F.col(value) > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return df.withColumn("qbin", F.when(F.col(value).isNotNull(), above))


def colour_kind(df: DataFrame, column: str, most: int = 10) -> str:
    """none, categorical or continuous; whole numbers with few distinct values are categories."""
    number = _number(df, column)
    row = df.agg(F.count(column).alias("n"), F.count(number).alias("numbers"), F.count_distinct(column).alias("d"), F.coalesce(F.bool_and(F.abs(number - F.rint(number)) < 1e-9), F.lit(False)).alias("whole")).first()
    if not row["n"]:
        return "none"
    if row["numbers"] < row["n"]:
        return "categorical"
    return "categorical" if row["whole"] and row["d"] <= most else "continuous"


def category_order(df: DataFrame, column: str) -> DataFrame:
    """value, n, rank: most frequent first, ties by value."""
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), F.asc_nulls_last("value"))))


def selection_band(newest: DataFrame, selected: DataFrame, at_least: int = 6) -> DataFrame:
    """sample_id, feature_name, mean, sd (of the population), n over the selected samples.

    From ``at_least`` of them on one band, whose sample_id is null; of fewer, each
    sample's own values as its mean, with sd null and n 1.
    """
    chosen = newest.join(selected.select("sample_id").distinct(), "sample_id", "left_semi")
    many = chosen.select("sample_id").distinct().limit(at_least).count() >= at_least
    if not many:
        return chosen.select("sample_id", "feature_name", F.col("value").cast("double").alias("mean"), F.lit(None).cast("double").alias("sd"), F.lit(1).cast("long").alias("n"))
    banded = chosen.groupBy("feature_name").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("value").alias("n"))
    return banded.select(F.lit(None).cast("string").alias("sample_id"), "feature_name", "mean", "sd", "n")


def population_band(features: DataFrame, statistics: DataFrame) -> DataFrame:
    """feature_name, mean, low, high: the catalogue's mean -/+ its deviation (missing: 0), in the asked features' rows."""
    joined = features.select("feature_name").distinct().join(statistics, "feature_name", "left")
    sd = F.coalesce("std", F.lit(0.0))
    return joined.select("feature_name", "mean", (F.col("mean") - sd).alias("low"), (F.col("mean") + sd).alias("high"))


def deviations(newest: DataFrame, statistics: DataFrame, sample_id: str, top: int) -> DataFrame:
    """The sample's features farthest from the mean; a top-k report."""
    mine = newest.where(F.col("sample_id") == sample_id).select("feature_name", "value")
    off = mine.join(statistics.select("feature_name", "mean"), "feature_name").withColumn("off", F.abs(F.col("value") - F.col("mean")))
    return off.orderBy(F.desc("off"), "feature_name").limit(top)


def z_scores(values: DataFrame, statistics: DataFrame, keys: list[str]) -> DataFrame:
    """``values`` with mean, std and z; rows without a value or a usable deviation are dropped."""
    joined = values.join(statistics, keys)
    usable = F.col("value").isNotNull() & F.col("mean").isNotNull() & F.col("std").isNotNull() & (F.col("std") != 0)
    return joined.where(usable).withColumn("z", (F.col("value") - F.col("mean")) / F.col("std"))


def flag_outliers(scored: DataFrame, threshold: float = 3.0) -> DataFrame:
    """``scored`` with whether each bin by itself is that far out."""
    return scored.withColumn("is_outlier", F.abs("z") >= threshold)


def with_sizes(bins: DataFrame, known: dict[str, int] | None = None) -> DataFrame:
    """chrom, size of the contigs in ``bins`` (chrom, bin_end): the known length, else the largest end of a bin."""
    table = F.create_map(*(x for c, n in (known or CHROMOSOMES).items() for x in (F.lit(c), F.lit(n).cast("long"))))
    return bins.groupBy("chrom").agg(F.max("bin_end").cast("long").alias("last")).select("chrom", F.coalesce(F.element_at(table, F.col("chrom")), F.col("last")).alias("size"))


def page(rows: DataFrame, number: int, size: int = 20, order: list[str] | None = None) -> DataFrame:
    """Rows of one page, from 0 on, in the order of the given columns (all, if none are)."""
    return rows.orderBy(*(F.col(f"`{c}`") for c in order or rows.columns)).offset(number * size).limit(size)


def stouffer(scored: DataFrame, by: list[str], threshold: float = 3.0) -> DataFrame:
    """The combined score of each group: sum of z over the root of their number."""
    combined = scored.groupBy(*by).agg((F.sum("z") / F.sqrt(F.count("*"))).alias("stouffer_z"), F.count("*").alias("n"))
    return combined.withColumn("is_outlier", F.abs("stouffer_z") >= threshold)


def offsets(contigs: DataFrame) -> DataFrame:
    """ord, chrom, size, offset: where each contig begins when they are laid end to end; a row a contig."""
    running = F.sum("size").over(W.orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    return contigs.withColumn("offset", (running - F.col("size")).cast("long"))


def genome_position(start: Column, end: Column, offset: Column) -> Column:
    """The middle of a bin along the genome."""
    return offset + (start + end) / 2


def scatter(wide: DataFrame, x: str, y: str, colour: str | None = None, log_x: bool = False, log_y: bool = False) -> DataFrame:
    """_sample_id, x, y and the colour; rows without either number, and not positive ones on log axes, are dropped."""
    px, py = _number(wide, x), _number(wide, y)
    keep = px.isNotNull() & py.isNotNull()
    if log_x:
        keep, px = keep & (px > 0), F.when(px > 0, F.log10(F.when(px > 0, px)))
    if log_y:
        keep, py = keep & (py > 0), F.when(py > 0, F.log10(F.when(py > 0, py)))
    out = [F.col("sample_id").alias("_sample_id"), px.alias("x"), py.alias("y")]
    if colour is not None:
        out.append(F.col(f"`{colour}`").alias("colour"))
    return wide.where(keep).select(*out)


def detail_columns(explicit: list[str] | None, x: str | None, y: str | None, colour: str | None) -> list[str]:
    """The columns asked for, else those of the plot, each once."""
    return list(dict.fromkeys(c for c in (explicit or [x, y, colour]) if c))

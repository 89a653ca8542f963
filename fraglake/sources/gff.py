"""Gene annotation in GFF3 or GTF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "seqid string, source string, type string, start long, end long, score string, strand string, phase string, attributes string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """All features, with ``attributes`` as a map; of a key given twice the last value stays."""
    rows = spark.read.schema(COLUMNS).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    pairs = F.regexp_extract_all("attributes", F.lit(r'([^\s;=]+)\s*=\s*([^;]*)|([^\s;=]+)\s+"([^"]*)"'), 0)
    key = lambda s: F.regexp_extract(s, r'^([^\s;=]+)', 1)
    value = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r'^[^\s;=]+\s*=?\s*', ""), '"', ""))
    distinct = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda s: F.struct(key(s), value(s)))))
    return rows.withColumn("attributes", distinct)


def genes(spark: SparkSession, path: str) -> DataFrame:
    """gene_id, gene (its name, else its id), chrom, start, end, strand, ord (file order); lines that repeat an id are merged to their hull."""
    rows = read(spark, path).where(F.col("type") == "gene")
    attribute = lambda k: F.try_element_at("attributes", F.lit(k))
    named = rows.select(
        F.coalesce(attribute("gene_id"), attribute("ID")).alias("gene_id"), F.coalesce(attribute("gene_name"), attribute("Name"), attribute("gene_id"), attribute("ID")).alias("gene"), F.col("seqid").alias("chrom"), "start", "end", "strand", F.monotonically_increasing_id().alias("ord")
    )
    return named.groupBy("gene_id", "gene", "chrom", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("ord").alias("ord"))

"""Reads, reference and annotation derived from the standard tables.

The expressions run unchanged in Spark and in DuckDB, so both see the same rows.
Contigs chr20, chr21 and chr22 have 200,000 bases each, in tiles of 32.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CONTIGS = [("chr20", 200_000), ("chr21", 200_000), ("chr22", 200_000)]
TILE = 32
GENES = 60

READS = {
    "sample_id": "concat('S', cast(l_suppkey % 8 as varchar(10)))",
    "qname": "concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(10)))",
    "chrom": "concat('chr', cast(20 + l_partkey % 3 as varchar(10)))",
    "reference_start": "(l_orderkey*7919 + l_linenumber*104729 + l_partkey*31) % 200000",
    "reference_end": "(l_orderkey*7919 + l_linenumber*104729 + l_partkey*31) % 200000 + 36 + l_partkey % 115",
    "template_length": "(60 + (l_partkey*13 + l_orderkey*17 + l_linenumber*29) % 541) * (case when l_linenumber % 2 = 0 then -1 else 1 end)",
    "flag": "cast(1 + 2 + (case when l_linenumber % 2 = 0 then 128+16 else 64+32 end) + (case when l_discount >= 0.09 then 1024 else 0 end) as int)",
    "mapq": "cast(case when l_tax >= 0.02 then 60 else l_quantity end as int)",
    "query_length": "36 + l_partkey % 115",
    "query_sequence": "translate(md5(concat(cast(l_orderkey as varchar(20)),'-',cast(l_linenumber as varchar(10)))), '0123456789abcdef','ACGTACGTACGTACGT')",
}
#: Every 97th tile is N, every 11th lower case.
TILES = {
    "chrom": "concat('chr', cast(20 + cast(floor(id / 6250) as int) as varchar(10)))",
    "tile": "id % 6250",
    "seq": "case when id % 97 = 0 then repeat('N', 32) when id % 11 = 0 then lower(translate(md5(concat('ref', cast(id as varchar(10)))), '0123456789abcdef','ACGTACGTACGTACGT')) else translate(md5(concat('ref', cast(id as varchar(10)))), '0123456789abcdef','ACGTACGTACGTACGT') end",
}
GENE_COLUMNS = {
    "gene": "concat('gene_', cast(id as varchar(10)))",
    "chrom": "concat('chr', cast(20 + id % 3 as varchar(10)))",
    '"start"': "10000 + 2000 * id",
    '"end"': "10000 + 2000 * id + 1500",
    "strand": "case when id % 2 = 0 then '+' else '-' end",
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} as {n}" for n, e in columns.items())


READS_SQL = f"select {_select(READS)} from lineitem"
TILES_SQL = f"select {_select(TILES)} from (select range as id from range(18750)) t"
GENES_SQL = f"select {_select(GENE_COLUMNS)} from (select range as id from range({GENES})) t"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.selectExpr(*(f"{e} as {n}" for n, e in READS.items()))


def tiles(spark: SparkSession) -> DataFrame:
    return spark.range(18_750).selectExpr(*(f"{e} as {n}" for n, e in TILES.items()))


def genes(spark: SparkSession) -> DataFrame:
    return spark.range(GENES).selectExpr(*(f"{e} as {n.replace(chr(34), chr(96))}" for n, e in GENE_COLUMNS.items()))


def contigs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTIGS, "chrom string, length long")


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned values: events by user, type and id."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("cast(user_id as string) as sample_id", "event_type as feature_name", "value", "event_id as version")


VALUES_SQL = "select cast(user_id as varchar) as sample_id, event_type as feature_name, value, event_id as version from events"

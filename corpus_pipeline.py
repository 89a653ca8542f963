"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and
returns the columns of ``documents``; the last returns packed pieces.  ``run``
writes each stage as Parquet and reads it again for the next.

Defined results: null ids are kept as they are and count as the largest where one of
a group stays; null and empty texts fail the quality rules' base rule; repeated rows
are judged alike, and one of them stays after the near-duplicates stage; without labels
nothing is toxic and only the base rule rejects; an empty benchmark leaks nothing; empty
documents give no rows; columns besides ``COLUMNS`` are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fraglake.llm import _store, decontaminate, near_dedup, packing, quality, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _begin(spark: SparkSession) -> None:
    """Bounded batches, and nothing held of the stages before."""
    _store.use_small_batches(spark)
    _store.release(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    _begin(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.train(docs, labels)).select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the risk-controlled rules of their language."""
    _begin(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, labels).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash blocks of five-word shingles, checked for a Jaccard similarity of at least 0.8."""
    _begin(spark)
    return near_dedup.keep_one(docs).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    _begin(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_leaks(docs, benchmark).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of at most 1024 tokens."""
    _begin(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The stages need a tokenizer, a trained classifier and XXH64: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _store.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""The operators of this subpackage applied to the standard tables.

Tables are read from ``{sf_dir}/NAME.parquet``; each query covers its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _store, decontaminate, html_extract, license_scan, packing, quality, sharding, simhash_dedup, token_output, toxicity, url_filter

#: (host, path, verdict)
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    _store.use_small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _store.fresh_path(spark, "token-shards")
    token_output.write(_table(spark, sf_dir, "documents", "doc_id", "text"), path)
    return token_output.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_url_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judge(_table(spark, sf_dir, "pages", "page_id", "url"), rules)


def op3_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _store.materialize(packing.cut(_table(spark, sf_dir, "documents", "doc_id", "text")), "pieces")
    return packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))


def op5_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    shuffled = sharding.external_shuffle(docs, _store.fresh_path(spark, "shuffled"))
    text = F.coalesce("text", F.lit(""))
    return shuffled.select(
        "doc_id",
        (F.octet_length(text).cast("long") + F.lit(16).cast("long")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_tree_bp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op7_fuzzy_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")


def op8_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.scores(docs, toxicity.train(docs, labels))


def op9_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash_dedup.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op10_risk_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents", "doc_id", "text", "lang"), _table(spark, sf_dir, "labels", "doc_id", "quality")
    measured = quality.measured(docs, labels)
    ruled = quality.judged(measured, quality.learn(measured))
    kept = ~quality.base_failed() & ~F.col("rejected")
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return ruled.select("doc_id", *columns, quality.base_failed().alias("base_failed"), kept.alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_repair_tokens, op2_url_bloom, op3_bin_completion, op4_spaced_seeds, op5_external_shuffle, op6_tree_bp, op7_fuzzy_notices, op8_nnpu_toxicity, op9_simhash_blocks, op10_risk_thresholds)
}

_RULE_ROWS = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)

ORACLE_SQL: dict[str, str] = {
    "op2_url_bloom": rf"""
        with rules(host, path, verdict) as (values {_RULE_ROWS}),
        parts as (
            select page_id, row_number() over () as r,
                   translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
            from pages),
        best as (
            select r, arg_max(rules.host || rules.path, length(rules.host || rules.path)) as rule, arg_max(verdict, length(rules.host || rules.path)) as verdict
            from parts join rules on (parts.host = rules.host or ends_with(parts.host, '.' || rules.host)) and starts_with(parts.path, rules.path)
            group by r)
        select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join best using (r)""",
}

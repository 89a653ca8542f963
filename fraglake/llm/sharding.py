"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters the records uniformly into buckets that fit in memory, by seeded
hashes.  Pass two brings each bucket into a random order with a Fisher-Yates shuffle
(Spark's ``shuffle`` of an array) and writes it.  The buckets one after another are
a random order of all records; it is cut into shards whose counts differ by one at
most (law ``rows``).

A bucket is bounded by construction: the hash covers the record's id, its text and
a seeded random number, so copies and repeated ids spread like all others.  The
number of buckets is the counted bytes of whole records over ``bucket_bytes``, and at
least a few for each shuffle partition.  Records that come from a shuffle are written
first, so that a repeated task draws the same numbers for the same records.

Where buckets begin is summed in two levels, groups of ``GROUP`` buckets and the groups,
so no task takes them all.

The records' order depends on the seed and on how the input's files are split;
the shards' sizes don't depend on either.

Only DataFrame functions are used.

Defined results: null ids and texts are records like others (a null text has no
bytes); empty and very long texts and repeated rows are kept (a record over
``bucket_bytes`` makes its bucket larger by itself); an empty table gives no rows;
fewer records than shards leave shards empty; extra columns are carried along, and
those named ``shard`` or ``slot`` come out as ``shard_input`` and ``slot_input`` (with
more underscores before it where that is taken too).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import _store

SHARDS = 40
SEED = 20_260
#: Bytes of records in a bucket, on average; at least so many buckets for each shuffle partition.
BUCKET_BYTES, LEAST_BUCKETS = 64 << 20, 4
#: Bucket starts, of 24 bytes each, that may be broadcast.
BROADCAST_BUCKETS = 2_000_000
GROUP = 4096


def record_bytes(docs: DataFrame) -> Column:
    """About how many bytes a record has, over all of its columns."""
    total = F.lit(64).cast("long")
    for f in docs.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        else:
            total = total + F.lit(8)
    return total


def scatter(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", n_buckets: int, seed: int = SEED) -> DataFrame:
    """Pass one: bucket, salt and record (a struct of all columns)."""
    record = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record")
    spread = docs.select(record, F.rand(seed).alias("salt"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "id", "text", "salt"), F.lit(n_buckets)).cast("int")
    return spread.select(bucket.alias("bucket"), "salt", "record")


def shuffle_buckets(scattered: DataFrame, seed: int = SEED) -> DataFrame:
    """Pass two: bucket, place (from 0, in a Fisher-Yates order of the bucket) and record."""
    # Sorted by the salt first, so that the order in which blocks arrive doesn't matter.
    ordered = F.array_sort(F.collect_list(F.struct("salt", "record")), lambda a, b: F.when(a["salt"] < b["salt"], -1).when(a["salt"] > b["salt"], 1).otherwise(0))
    gathered = scattered.groupBy("bucket").agg(ordered.alias("records"))
    placed = gathered.select("bucket", F.posexplode(F.shuffle("records", seed)).alias("place", "drawn"))
    return placed.select("bucket", "place", F.col("drawn.record").alias("record"))


def external_shuffle(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", n_shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write ``docs`` in random order to ``path`` and return them with shard and slot, read back from there."""
    docs = _store.stable(docs, "to-shuffle")
    spark = docs.sparkSession
    size = docs.agg(F.sum(record_bytes(docs)).alias("n")).first()["n"] or 0
    n_buckets = max(-(-size // bucket_bytes), LEAST_BUCKETS * _store.shuffle_partitions(spark))
    shuffled = shuffle_buckets(scatter(docs, text_col=text_col, id_col=id_col, n_buckets=n_buckets, seed=seed), seed)
    shuffled.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(shuffled.schema).parquet(path)
    columns = []
    for c in docs.columns:
        name = _store.free_name(docs, f"{c}_input") if c.lower() in ("shard", "slot") else c
        columns.append(F.col("record").getField(c).alias(name))
    return cut_shards(written, n_shards, n_buckets).select(*columns, "shard", "slot")


def bucket_starts(counts: DataFrame) -> DataFrame:
    """bucket, before (records in the buckets before it) and total, from bucket and n."""
    grouped = counts.withColumn("group", F.floor(F.col("bucket") / F.lit(GROUP)))
    inside = W.partitionBy("group").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    local = grouped.select("bucket", "group", (F.sum("n").over(inside) - F.col("n")).alias("local"))
    totals = grouped.groupBy("group").agg(F.sum("n").alias("n"))  # a row for GROUP buckets
    running = W.orderBy("group").rowsBetween(W.unboundedPreceding, 0)
    groups = totals.select("group", (F.sum("n").over(running) - F.col("n")).alias("earlier"), F.sum("n").over(W.partitionBy()).alias("total"))
    return local.join(groups, "group").select("bucket", (F.col("earlier") + F.col("local")).alias("before"), "total")


def cut_shards(written: DataFrame, n_shards: int = SHARDS, n_buckets: int | None = None) -> DataFrame:
    """Shard and slot from bucket and place; counts of the shards differ by one at most.

    Where ``n_buckets`` says that the buckets' starts are few, they are broadcast,
    so that the records aren't shuffled once more.
    """
    starts = bucket_starts(written.groupBy("bucket").agg(F.count("*").alias("n")))
    at = F.col("before") + F.col("place")
    # The first total % n shards have a row more.
    small, extra = F.floor(F.col("total") / F.lit(n_shards)), F.col("total") % F.lit(n_shards)
    big = extra * (small + 1)
    shard = F.when(at < big, F.floor(at / (small + 1))).otherwise(extra + F.floor((at - big) / F.greatest(small, F.lit(1))))
    start = F.when(at < big, F.col("shard") * (small + 1)).otherwise(big + (F.col("shard") - extra) * small)
    if n_buckets is not None and n_buckets <= BROADCAST_BUCKETS:
        starts = F.broadcast(starts)
    return written.join(starts, "bucket").withColumn("shard", shard.cast("int")).withColumn("slot", (at - start).cast("long"))

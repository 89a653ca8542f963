"""Store rows that land as files, as a stream.

Each micro-batch is appended under its own stamp; readers pick the newest version of a
value, so late, repeated and re-delivered files need no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store, ingest_stamp


def values_stream(spark: SparkSession, folder: str, value_type: str = "double", max_files: int = 1000) -> DataFrame:
    """Parquet files of (sample_id, feature_name, value, version) as they arrive."""
    schema = f"sample_id string, feature_name string, value {value_type}, version long"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def append_to(stream: DataFrame, store: Store, logical: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append each batch to the store; a batch that is repeated after a failure rewrites equal rows, which reading resolves."""

    def one(batch: DataFrame, batch_id: int) -> None:
        store.append(logical, batch.withColumn("ingest_seq", F.lit(ingest_stamp()).cast("long")))

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_counts(stream: DataFrame, time_col: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """How many values of each feature arrived by window of event time; state is dropped once the watermark passes."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width), "feature_name").agg(F.count("*").alias("n"))

"""Tables written to the folder that driver and executors share.

``materialize`` cuts lineage with a written Parquet table.  A lost executor then
costs a re-read instead of a recomputation, and a result that is used twice is
computed once.  ``cleanup`` removes what a session has written; call it when its
results aren't read any more.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where ``spark.checkpoint.dir`` is unset and the master is local; removed when the process ends.
LOCAL_FOLDER = f"/tmp/checkpoints/fraglake-{uuid.uuid4().hex}"
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; raises on a cluster that names none."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_FOLDER


@atexit.register
def _remove_local() -> None:
    if any(p.startswith(LOCAL_FOLDER) for p in _written):
        shutil.rmtree(LOCAL_FOLDER, ignore_errors=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


@contextmanager
def _freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files, on disk or in the driver's tables; nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, compression: str = "zstd", narrow: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it; narrow tables in an eighth as many files as there are shuffle partitions."""
    return materialize_parts([df], name, compression, narrow)


def materialize_parts(parts: list[DataFrame], name: str, compression: str = "zstd", narrow: bool = False) -> DataFrame:
    """Write tables of the same columns one after another, so that only one is shuffled at a time, and return a scan of all."""
    spark = parts[0].sparkSession
    path = fresh_path(spark, name)
    for df in parts:
        if narrow:
            df = df.coalesce(-(-shuffle_partitions(spark) // 8))
        with _freed_shuffles(spark):
            df.write.mode("append").option("compression", compression).parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)


def stable(df: DataFrame, name: str) -> DataFrame:
    """``df``, written first if its rows come from a shuffle: a task that is repeated then reads the same rows in the same order."""
    return materialize(df, name) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


#: Row numbers, of 8 bytes each, that may be broadcast.
BROADCAST_ROWS = 1_000_000


def few(df: DataFrame, bound: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Narrow rows, marked for broadcast if they are at most ``most``: by ``bound``, which they can't exceed, else written and counted."""
    if bound <= most:
        return F.broadcast(df)
    df = materialize(df, "counted")
    return F.broadcast(df) if df.count() <= most else df


def release(spark: SparkSession) -> None:
    """Collect what isn't referred to any more, on the driver: its memory is given back, and Spark drops broadcasts only once their handles are collected."""
    gc.collect()
    spark._jvm.System.gc()


def cleanup(spark: SparkSession) -> None:
    """Delete all that this process has written to the shared folder; tables read from there can't be read any more."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Texts in an Arrow batch, and in a batch of the Parquet reader; Spark's own settings of 10,000 and 4096 are meant for rows of numbers.
BATCH_ROWS, READER_ROWS = 500, 256


def use_small_batches(spark: SparkSession) -> None:
    """Bound the texts that are held at a time, unless the session is set lower already."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)):
        if not 0 < int(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))

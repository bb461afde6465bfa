"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers that a task takes at least.
TASK_ROWS = 50_000
#: What Spark sends to a Python worker at a time, and by default.
BATCH, BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20, "67108864b"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); only a local session has one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints/inkmill"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """df in no more tasks than so many rows need; more rows than a few tasks' keep the partitions they have."""
    return df.coalesce(-(-rows // TASK_ROWS) or 1)


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends rows to Python workers in batches of BATCH_BYTES, unless it was given a bound of its own."""
    if spark.conf.get(BATCH) == BATCH_DEFAULT:
        spark.conf.set(BATCH, BATCH_BYTES)


def columns(names: list[str]) -> list[Column]:
    """Columns by their whole names, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def release(spark: SparkSession, wait: float = 0) -> None:
    """Let Spark drop the shuffle files of jobs that are over: it does so once the driver's garbage is collected.

    Listeners, as of event logs, hold the last job's plan for a moment after its end; wait is how many seconds they are given.
    """
    gc.collect()
    time.sleep(wait)
    spark.sparkContext._jvm.System.gc()


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; the quick built-in wherever the text is plain ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def broadcast_if(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Broadcast hint only for a side whose counted rows stay under a bound."""
    return F.broadcast(df) if rows <= bound else df

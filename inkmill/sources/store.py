"""A chunk store partitioned by source: replace, delete and update by whole partitions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Files that a source's rows are dealt to; each holds FILE_ROWS rows at most.
FILES_A_SOURCE, FILE_ROWS = 16, 1_000_000


def write_chunks(chunks: DataFrame, path: str, files: int = FILES_A_SOURCE) -> None:
    """Put chunks(source, ...) into the store; sources that are written replace what they had, others stay.

    The new partitions are complete before old ones go, so a failed write leaves the old rows. Rows are dealt by source and
    a hash of the row, so no task writes all of a large source; adaptive execution joins what is small.
    """
    salt = F.pmod(F.xxhash64(*(c for c, kind in chunks.dtypes if "map" not in kind and "variant" not in kind)), F.lit(files))
    chunks.repartition(F.col("source"), salt).write.option("maxRecordsPerFile", FILE_ROWS).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def delete_sources(spark: SparkSession, path: str, sources: list[str]) -> int:
    """Drop the partitions of sources; how many rows went.

    The store is seen as a table for the time of the call, and each source's partition is overwritten with no rows.
    """
    store = read_chunks(spark, path)
    gone = store.where(F.col("source").isin(sources)).count()
    name = f"store_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in store.schema)
    nothing = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()})" for f in store.schema if f.name != "source")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{path}', partitionOverwriteMode 'static') PARTITIONED BY (source)")
    try:
        for s in sources:
            spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (source = :s) SELECT {nothing} WHERE false", args={"s": s})
    finally:
        spark.sql(f"DROP TABLE {name}")
    return gone


def set_region(spark: SparkSession, path: str, source: str, region: str) -> None:
    """Set metadata.region_code of a source's rows, by way of a staged copy."""
    rows = read_chunks(spark, path).where(F.col("source") == source).withColumn("metadata", F.col("metadata").withField("region_code", F.lit(region)))
    staged = f"{path}.staged"
    rows.write.mode("overwrite").parquet(staged)
    write_chunks(spark.read.parquet(staged), path)

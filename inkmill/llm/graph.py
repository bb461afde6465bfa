"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, fitted, forget, release, scratch

#: Minima of so many edges at most are broadcast.
BROADCAST_EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Alternates the large-star and small-star steps: every node's neighbours are hung on its smallest neighbour,
    by a grouped minimum and an equi-join, so no neighbour list is ever gathered. Minima are written before they are
    joined, so that Spark deals the rows of a node with many neighbours anew. A turn's tasks and files are as many as its edges
    need, and its files go once the next one is written. Null ends and loops are dropped; an empty table gives an empty table.
    """
    spark, turn = edges.sparkSession, scratch(edges.sparkSession, "edges")

    def put(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        (df if rows is None else fitted(df, rows)).write.parquet(f"{turn}/{name}")
        return spark.read.schema(df.schema).parquet(f"{turn}/{name}")

    e = put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before, n = None, e.count()
    while True:
        last, turn = turn, scratch(spark, "edges")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low", 2 * n)
        hung = both.where("v > u").join(broadcast_if(low, n, BROADCAST_EDGES), "u")
        large = put(hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large", n)
        low = put(large.groupBy("u").agg(F.min("v").alias("m")), "least", n)
        small = large.join(broadcast_if(low, n, BROADCAST_EDGES), "u")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        e = put(small, "edges", n)
        forget(spark, last)
        release(spark)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before, n = state, state[0]
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return fitted(ends.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component")), 2 * n)

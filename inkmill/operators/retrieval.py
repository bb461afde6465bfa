"""Retrieval experiments: lexical and vector rankings of many queries at once, their fusion, and how good a ranking is."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged
from .embedding import WORD

#: Queries that meet all rows in one pass.
QUERIES = 2_000
#: Scores are whole millionths, so that sums don't depend on their order.
UNIT = 1_000_000
BROADCAST_ROWS = 500_000
#: Pairs of a query and a row that a task may add up at most, so its memory doesn't grow with the rows.
PAIRS = 1 << 20


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, rank, score): the k highest of each query, equal ones by doc_id. Spark keeps k a query in each task before it deals them."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "doc_id", "rank", "score")


def lexical(documents: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents(doc_id, text) of each of queries(query_id, text) by BM25 over an inverted index of the queries' words.

    The index is dealt by document to as many tasks as its pairs with queries need; each adds up all pairs of its documents and keeps k a query.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
    n_asked = asked.limit(BROADCAST_ROWS + 1).count()
    small = lambda df: F.broadcast(df) if n_asked <= BROADCAST_ROWS else df
    lengths = documents.select(F.size(_words(F.col("text"))).alias("n")).where("n > 0").agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
    each = documents.select("doc_id", _words(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    index = staged(each.join(small(asked.select("word").distinct()), "word", "left_semi").groupBy("word", "doc_id", "n").agg(F.count("*").alias("tf")), "index")
    df = index.groupBy("word").agg(F.count("*").alias("df"))
    rarity = F.log(1 + (F.lit(float(lengths["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.lit(float(lengths["mean"] or 1))))
    terms = asked.join(small(df.select("word", rarity.alias("rarity"))), "word")
    n_queries = asked.select("query_id").distinct().count()
    dealt = lambda df: df.repartition(max(documents.sparkSession.sparkContext.defaultParallelism, -(-lengths["n"] * n_queries // PAIRS)), "doc_id")
    met = dealt(index).join(small(terms), "word") if n_asked <= BROADCAST_ROWS else dealt(index.join(terms, "word"))
    scores = met.groupBy("query_id", "doc_id").agg(F.sum(F.floor(UNIT * F.col("rarity") * part).cast("long")).alias("score"))
    return _best(scores, k)


def vectors(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest of rows(doc_id, embedding) to each of queries(query_id, embedding) by cosine, exactly.

    Queries go to the rows QUERIES at a time, as a matrix; a task keeps k of each batch of rows for each query. Zero vectors have no
    direction and take no part.
    """
    spark = rows.sparkSession
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).where(norm > 0)
    n = asked.count()
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // QUERIES)))))
    found = []
    for block in range(max(1, -(-n // QUERIES))):
        own = asked.where(F.col("block") == block).collect()  # about QUERIES rows
        if own:
            found.append(_nearest(rows, spark.sparkContext.broadcast(([r["query_id"] for r in own], np.array([r["embedding"] for r in own]))), k))
    if not found:
        return rows.select(F.lit(None).cast("long").alias("query_id"), F.col("doc_id").cast("long"), F.lit(0).alias("rank"), F.lit(0.0).alias("score")).where("false")
    return _best(reduce(DataFrame.unionByName, found), k)


def _nearest(rows: DataFrame, sent, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        for b in batches:
            x = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
            size = (x * x).sum(1)
            doc, x, size = b.column(0).to_numpy()[size > 0], x[size > 0], size[size > 0]
            if not len(x):
                continue
            score = (q @ x.T) / np.sqrt((q * q).sum(1)[:, None] * size[None, :])
            m = min(k, len(x))
            cutoff = np.partition(score, len(x) - m, axis=1)[:, len(x) - m]
            at, col = np.nonzero(score >= cutoff[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids)[at]), pa.array(doc[col]), pa.array(score[at, col])], ["query_id", "doc_id", "score"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>")).where("embedding IS NOT NULL").mapInArrow(run, "query_id long, doc_id long, score double")


def fuse(rankings: list[DataFrame], k: int = 10, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of rankings(query_id, doc_id, rank)."""
    each = reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", "rank") for r in rankings])
    return _best(each.groupBy("query_id", "doc_id").agg(F.sum(F.floor(F.lit(UNIT) / (constant + F.col("rank"))).cast("long")).alias("score")), k)


def evaluate(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, ndcg, first) of ranked(query_id, doc_id, rank) for relevant(query_id, doc_id, gain).

    recall is the share of a query's relevant documents among its first k, ndcg the discounted gain over that of the best order, first the
    reciprocal rank of the first relevant one. Queries without relevant documents are left out.
    """
    discount = lambda at: F.log2(at + 1)
    order = Window.partitionBy("query_id").orderBy(F.col("gain").desc(), "doc_id")
    best = relevant.where("gain > 0").withColumn("place", F.row_number().over(order))
    ideal = best.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("place") <= k, F.col("gain") / discount(F.col("place")))).alias("ideal"))
    hit = ranked.where(F.col("rank") <= k).join(relevant.where("gain > 0"), ["query_id", "doc_id"])
    got = hit.groupBy("query_id").agg(F.count("*").alias("hits"), F.sum(F.col("gain") / discount(F.col("rank"))).alias("dcg"), F.min("rank").alias("first"))
    zero = F.lit(0.0)
    return ideal.join(got, "query_id", "left").select("query_id", F.coalesce(F.col("hits") / F.col("n"), zero).alias("recall"), F.coalesce(F.col("dcg") / F.col("ideal"), zero).alias("ndcg"), F.coalesce(1 / F.col("first"), zero).alias("first"))

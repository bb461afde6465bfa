"""Importance resampling towards a target distribution, by hashed word n-grams.

Every text has features: all runs of 1 to 2 consecutive words. A feature's bucket is its checksum modulo BUCKETS. Buckets are
counted over all documents and over all target texts; a bucket's gain is the floored logarithm of how much oftener it stands in the
targets, both smoothed by one. A document's weight is the floored mean of its features' gains, and its score that weight and Gumbel noise
drawn from its doc_id, so that the highest scores are a draw without replacement by the weights.

No feature is exploded to be scored: higher-order functions make a document's bucket array, and ``aggregate`` sums
``element_at`` of a literal array of BUCKETS gains. Counting adds up within tasks, so what shuffles is at most BUCKETS totals a
task. The gains, BUCKETS numbers, are all that reaches the driver. Documents are ranked by ranges of the score: rows are dealt by
range, numbered within each, and each range begins where the counts of those before it end, so that no task holds more
than its share.

Nulls and odd input: a null or empty text has no features, weight 0, and too few words to be drawn. A null doc_id draws its noise
as an empty id, and ranks after others of its score. Repeated rows are drawn each for itself; equal rows take following ranks. Very
long texts cost in proportion. Extra columns are ignored. No documents give no rows; no target texts give gains from the
documents alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .decontaminate import words

BUCKETS, RUN = 10_000, 2
#: Documents of fewer words are not drawn.
LEAST_WORDS = 20
SEED = 7
#: Rows of a range of scores.
RANGE_ROWS = 1_000_000


def _buckets(w: Column, run: int, buckets: int) -> Column:
    """The bucket of every run of 1 to ``run`` words of a word array."""
    of = lambda s: (F.crc32(s.cast("binary")) % buckets).cast("int")
    starts = lambda k: F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
    runs = lambda k: F.transform(starts(k), lambda i: of(F.concat_ws(" ", *(F.get(w, i + j) for j in range(k)))))
    return F.concat(F.transform(w, of), *(runs(k) for k in range(2, run + 1)))


def gains(documents: DataFrame, targets: DataFrame, run: int = RUN, buckets: int = BUCKETS, least: int = LEAST_WORDS) -> tuple[list[int], int]:
    """Each bucket's gain, and how many documents have ``least`` words or more."""
    long_enough = F.when(F.size("w") >= least, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))
    of = lambda df, more: df.select(words(F.col("text")).alias("w")).select(F.explode(F.concat(_buckets(F.col("w"), run, buckets), *more)).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    each = of(documents, [long_enough]).select("b", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    each = each.unionByName(of(targets, []).select("b", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    counts = {r["b"]: (r["s"], r["t"]) for r in each.groupBy("b").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()}  # at most buckets + 1 rows
    n = counts.pop(-1, (0, 0))[0]
    total = [sum(x[k] for x in counts.values()) for k in (0, 1)]
    rows = [(b, *counts.get(b, (0, 0))) for b in range(buckets)]
    ratio = (F.col("t").cast("double") + 1) * F.lit(float(total[0] + buckets)) / ((F.col("s").cast("double") + 1) * F.lit(float(total[1] + buckets)))
    found = documents.sparkSession.createDataFrame(rows, "b int, s long, t long").select("b", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))
    return [r["gain"] for r in sorted(found.collect())], n


def scored(documents: DataFrame, gain: list[int], run: int = RUN, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of documents(doc_id, text)."""
    # One literal that is split while planning; an array of so many literals would make a tree of as many nodes.
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    total = F.aggregate(_buckets(F.col("w"), run, len(gain)), F.lit(0).cast("long"), lambda a, b: a + F.element_at(table, b + 1))
    n_features = reduce(lambda a, b: a + b, (F.greatest(F.size("w") - k, F.lit(0)) for k in range(run))).cast("long")
    docs = docs.select("doc_id", F.size("w").cast("long").alias("n_words"), n_features.alias("n_features"), total.alias("total"))
    # Division of whole numbers that goes down for sums below zero as well.
    weight = F.when(F.col("n_features") > 0, ((F.col("total") - F.pmod("total", "n_features")) / F.col("n_features")).cast("long")).otherwise(F.lit(0).cast("long"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    return docs.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise).alias("score"))


def resample(documents: DataFrame, targets: DataFrame, percent: int = 25, run: int = RUN, buckets: int = BUCKETS, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of documents(doc_id, text); rank is null where a row isn't drawn.

    Of the documents with ``least`` words or more, ``percent`` in a hundred (rounded down) are drawn.
    """
    gain, n = gains(documents, targets, run, buckets, least)
    rows = cut(scored(documents, gain, run, seed), "scored")
    spark, drawn, columns = documents.sparkSession, percent * n // 100, ("doc_id", "n_features", "weight", "score")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("tie")]
    # Rows that are equal in all of this are still dealt to several ranges.
    may = rows.where(F.col("n_words") >= least).withColumn("tie", F.monotonically_increasing_id())
    ranges = max(n // RANGE_ROWS + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = may.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = cut(dealt.select(*columns, F.spark_partition_id().alias("part"), place.alias("place")), "ranges")
    upto, begins = 0, []
    for r in sorted(dealt.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row for each range
        begins.append((r["part"], upto))
        upto += r["n"]
    begin = F.broadcast(spark.createDataFrame(begins, "part int, upto long"))  # a row for each range
    rank = F.col("upto") + F.col("place") + 1
    ranked = dealt.join(begin, "part").select(*columns, F.when(rank <= drawn, rank).alias("rank"))
    return ranked.unionByName(rows.where(F.col("n_words") < least).select(*columns, F.lit(None).cast("long").alias("rank")))

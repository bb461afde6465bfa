"""Ranked lexical search over a tiered index of postings, exact.

A document's terms have impacts, whole numbers below IMPACT that grow with the term's count and shrink with the document's length; a
posting's share of a score is its impact times the weight of the term, which falls with the number of documents that hold it.

``build_index`` writes postings in blocks: for a slice of the documents and a term, the rows that hold it and their impacts, a block for
each level of impact. Blocks lie in a folder for each level, so that high impacts are read without the others; documents' ids
lie beside them. Building shuffles nothing, and a frequent term is spread over as many blocks as there are slices.

``search`` cuts each term's levels into tiers, those of high impact first: a tier takes levels while the term's postings so far stay within
a share of all documents, so that rare terms are in the first tier altogether. What a term may still add beyond a tier is its residual
bound, the largest impact that it has below. From the postings of a tier and those above it, every document met has a least and a most
possible score. An item is settled at a tier if its k-th least score is above what documents not met can reach; then only
documents that may reach that score are candidates, and they alone get their exact scores. Items without that proof fall through
to the next tier, and to the last, which holds all postings and needs no proof.

An item's documents are ranked in salted groups first, so that neither a common item nor ties of a third of all rows meet in one task.

Nulls and odd input: a null text has no terms; such documents are not counted, and such items get no rows. Rows that repeat are
ranked each for itself, and rows of items are answered each for itself. Equal scores go by ascending doc_id, null last. Very long texts cost
in proportion. Extra columns are ignored. An empty table of either kind gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if, cut
from .subwords import coded, in_slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same for Arrow, and what stands between terms; new lines are like other characters there.
ARROW_TERM, ARROW_BETWEEN = TERM, TERM.replace("^", "")
#: Impacts are below this, and fall into this many levels.
IMPACT, LEVELS = 1_000_000, 8
#: Shares of all documents (one in so many) that a term's postings may make up in the tiers before the last.
TIERS = (16, 4)
#: Documents of a slice.
ROWS = 1000
#: Items' terms, candidates and like tables are broadcast up to this many rows.
BROADCAST_ROWS = 200_000
#: Documents of an item that a task ranks, about.
RANKED_ROWS = 100_000


def terms(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def _cut_terms(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Distinct terms of texts, each occurrence's number among them, and where each text's begin (with the end last)."""
    lists = pc.split_pattern_regex(pc.fill_null(pc.ascii_lower(texts), ""), ARROW_BETWEEN)
    vocabulary, code, off = coded(lists)
    # What stands before the first term and behind the last is empty.
    full = pc.not_equal(vocabulary, "").to_numpy(zero_copy_only=False)[code] if len(code) else np.empty(0, bool)
    return vocabulary, code[full].astype(np.int64), np.r_[0, np.cumsum(full)][off].astype(np.int64)


def build_index(documents: DataFrame, path: str) -> None:
    """Write the index of documents(doc_id, text) to path."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, ROWS):
            n = pc.fill_null(pc.count_substring_regex(b.column(0), ARROW_TERM), 0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([np.count_nonzero(n)], pa.int64()), pa.array([n.sum()], pa.int64())], ["count", "total"])

    count, total = documents.select("text").mapInArrow(lengths, "count long, total long").agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    schema = pa.schema([("level", pa.int32()), ("term", pa.string()), ("n", pa.int64()), ("most", pa.int64()), ("rows", pa.list_(pa.int64())), ("impacts", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64()))])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, ROWS):
            vocabulary, code, off = _cut_terms(b.column(2))
            row, n = b.column(0).to_numpy(), np.diff(off)
            empty = pa.array([None], pa.string())
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(1))
            none = pa.array([[]], pa.list_(pa.int32()))
            rows = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), empty, pa.array([np.count_nonzero(n)], pa.int64()), pa.array([0], pa.int64()), rows, none, ids], schema=schema)
            if not len(code):
                continue
            width = len(vocabulary)
            pairs, tf = np.unique(np.repeat(np.arange(len(n)), n) * width + code, return_counts=True)
            doc, code = pairs // width, pairs % width
            m = 25 + 75 * n[doc] * count // total
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)
            key = code * LEVELS + impact * LEVELS // IMPACT
            order = np.argsort(key, kind="stable")
            doc, impact, key = doc[order], impact[order], key[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = pa.array(np.r_[starts, len(key)], pa.int32())
            key = key[starts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key % LEVELS, pa.int32()),
                    vocabulary.take(pa.array(key // LEVELS)),
                    pa.array(np.diff(np.r_[starts, len(doc)]), pa.int64()),
                    pa.array(np.maximum.reduceat(impact, starts), pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(row[doc])),
                    pa.ListArray.from_arrays(ends, pa.array(impact.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(np.zeros(len(starts) + 1), pa.int32()), pa.array([], pa.int64())),
                ],
                schema=schema,
            )

    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs.mapInArrow(blocks, "level int, term string, n long, most long, rows array<long>, impacts array<int>, doc_ids array<long>").write.partitionBy("level").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, n long, most long, rows array<long>, impacts array<int>, doc_ids array<long>, level int").parquet(path)


def _plan(postings: DataFrame, wanted: DataFrame, n_wanted: int, n_docs: int, shares: tuple[int, ...]) -> DataFrame:
    """(q, term, level, tier, share, bounds) of wanted(q, term, times): a posting's impact counts share times; bounds[s] is the most beyond tier s."""
    vocabulary = wanted.select("term").distinct()
    per = postings.join(broadcast_if(vocabulary, n_wanted, BROADCAST_ROWS), "term").groupBy("term", "level").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    # A term has at most LEVELS rows here.
    upto, df = F.sum("n").over(W.partitionBy("term").orderBy(F.col("level").desc())), F.sum("n").over(W.partitionBy("term"))
    tier = reduce(lambda a, b: a + b, [(upto > n_docs // s).cast("int") for s in shares])
    w = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * df + 1).cast("double"))).cast("long")
    per = per.select("term", "level", "most", tier.alias("tier"), w.alias("w"))
    bounds = F.array(*(F.coalesce(F.max(F.when(F.col("tier") > s, F.col("most"))).over(W.partitionBy("term")), F.lit(0).cast("long")) for s in range(len(shares))))
    per = cut(per.withColumn("bounds", bounds), "levels")
    return cut(wanted.join(broadcast_if(per, per.count(), BROADCAST_ROWS), "term").select("q", "term", "level", "tier", (F.col("times") * F.col("w")).alias("share"), "bounds"), "plan")


def search(index: DataFrame, items: DataFrame, k: int = 10, shares: tuple[int, ...] = TIERS) -> DataFrame:
    """item_id, rank, doc_id, score and tier (where it was settled, from 0) of the k best documents of every row of items(item_id, text)."""
    small = lambda df, rows=None: broadcast_if(df, df.count() if rows is None else rows, BROADCAST_ROWS)
    questions = cut(items.select(F.monotonically_increasing_id().alias("q"), "item_id", terms(F.col("text")).alias("terms")), "items")
    wanted = cut(questions.select("q", F.explode("terms").alias("term")).groupBy("q", "term").agg(F.count("*").alias("times")), "terms")
    postings, n_docs, n_items = index.where("level >= 0"), index.where("level < 0").agg(F.sum("n")).first()[0] or 0, questions.count()
    plan = _plan(postings, wanted, wanted.count(), n_docs, shares)

    def hits(part: DataFrame, *more: Column) -> DataFrame:
        """(q, share, ..., row, impact) of the postings that the part of the plan asks for."""
        return postings.join(small(part), ["term", "level"]).select("q", "share", *more, F.inline(F.arrays_zip("rows", "impacts"))).withColumnsRenamed({"rows": "row", "impacts": "impact"})

    left, settled = questions.select("q"), []
    for s in range(len(shares)):
        own = plan.join(small(left, n_items), "q", "left_semi").withColumn("bound", F.col("share") * F.get("bounds", F.lit(s)))
        met = hits(own.where(F.col("tier") <= s), F.col("bound"))
        met = cut(met.groupBy("q", "row").agg(F.sum(F.col("share") * F.col("impact")).alias("least"), F.sum("bound").alias("known")), "met")
        best = met.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.col("least").desc()))).where(F.col("place") <= k)
        best = best.groupBy("q").agg(F.count("*").alias("n"), F.min("least").alias("goal")).where(F.col("n") == k)
        # What a document not met here can reach at most.
        beyond = own.select("q", "term", "bound").distinct().groupBy("q").agg(F.sum("bound").alias("beyond"))
        proven = cut(best.join(beyond, "q").where("goal > beyond").select("q", "goal", "beyond"), "proven")
        found = met.join(small(proven, n_items), "q").where(F.col("least") + F.col("beyond") - F.col("known") >= F.col("goal"))
        settled.append(cut(found.select("q", "row", F.lit(s).alias("tier")), "candidates"))
        left = cut(left.join(small(proven, n_items), "q", "left_anti"), "left")

    score = F.sum(F.col("share") * F.col("impact")).alias("score")
    scores = hits(plan.join(small(left, n_items), "q", "left_semi")).groupBy("q", "row").agg(score, F.lit(len(shares)).alias("tier"))
    candidates = reduce(DataFrame.unionByName, settled)
    exact = hits(plan.join(small(left, n_items), "q", "left_anti")).join(small(candidates), ["q", "row"]).groupBy("q", "row", "tier").agg(score)
    scores = scores.unionByName(exact).where("score > 0").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(n_docs // RANKED_ROWS + 1)))
    top = scores.withColumn("place", F.rank().over(W.partitionBy("q", "salt").orderBy(F.col("score").desc()))).where(F.col("place") <= k)
    top = cut(top.select("q", "row", "score", "tier"), "top")
    ids = index.where("level < 0").select(F.inline(F.arrays_zip("rows", "doc_ids"))).withColumnsRenamed({"rows": "row", "doc_ids": "doc_id"})
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranked = ids.join(small(top), "row").withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.join(small(questions, n_items), "q").select("item_id", "rank", "doc_id", "score", "tier")

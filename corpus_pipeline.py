"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Each stage works on all rows that its predecessor kept, and all but the last return the columns of documents:
1. quality: rows whose quality score is below 0.3 go;
2. toxicity: rows whose toxicity score is 0.5 or more go;
3. near_duplicates: one row of each group of near-duplicates stays, that of the smallest doc_id;
4. decontamination: rows that hold a ten-word window of a benchmark item go;
5. pieces: every row left gets the SentencePiece ids of its whole text.

Nulls and odd input: null and empty texts are scored like any text, are in no group of near-duplicates, hold no item and have no ids.
Rows that repeat are judged each for itself, but for near-duplicates, of which one stays. Columns beyond those of documents are
kept by all stages but the last, whatever their names, dots included. Very long texts are judged whole. Of near-duplicates with the same doc_id the text of the smallest hash stays; scores at a bound go as the
bound says. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm import decontaminate, neardup, pieces, quality, toxicity
from inkmill.llm.common import scratch, small_batches, table
from inkmill.llm.queries import piece_model


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.accept(docs, table(spark, sf_dir, "labels"), 0.3)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.accept(docs, table(spark, sf_dir, "labels"), 0.5)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return neardup.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_ids(docs, piece_model()).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("pieces", pieces_stage),
]

#: Trained scores and piece merges have no SQL. Tests compare the third and fourth stage with brute force, the fifth with the
#: library, and the first two with their models' scores, whose parts are tested on their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made, path = stage(spark, docs, sf_dir), scratch(spark, f"stage-{name}")
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs

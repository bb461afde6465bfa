"""Names found in texts: all names of a table at once, the longest first.

Up to BROADCAST_NAMES names go to the tasks as one automaton, which reads each text once whatever their number. Beyond that, texts meet the
names by a join on the first characters of a name. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_NAMES = 500_000
MANUAL = "manual_required"


def _by_automaton(rows: DataFrame, names: DataFrame) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast([r["name"] for r in names.collect()])  # at most BROADCAST_NAMES names

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in sent.value:
            automaton.add_word(name, name)
        if sent.value:
            automaton.make_automaton()
        for b in batches:
            ids, found, places = [], [], []
            for k, text in enumerate(b.column(1).to_pylist()) if sent.value else ():
                seen = set()
                for end, name in automaton.iter(text or ""):
                    if name not in seen:
                        seen.add(name)
                        ids.append(k)
                        found.append(name)
                        places.append(end - len(name) + 2)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(found, pa.string()), pa.array(places, pa.int32())], ["row", "name", "place"])

    return rows.select("row", "text").mapInArrow(find, "row long, name string, place int")


def _by_prefix(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Every place of a text meets the names that begin as the text does there."""
    least = names.agg(F.min(F.length("name"))).first()[0] or 1
    starts = F.sequence(F.lit(1), F.length("text"))
    places = rows.where(F.length("text") >= least).select("row", "text", F.explode(starts).alias("place")).withColumn("head", F.substring("text", F.col("place"), F.lit(least)))
    met = places.join(names.select("name", F.substring("name", 1, least).alias("head")), "head")
    fits = met.where(F.substring("text", F.col("place"), F.length("name")) == F.col("name"))
    return fits.groupBy("row", "name").agg(F.min("place").alias("place"))


def find_names(rows: DataFrame, names: DataFrame, most: int = BROADCAST_NAMES) -> DataFrame:
    """(row, name, place): the names of names(name) that rows(row, text) hold, each at its first place, counted from 1.

    Null and empty names are none; a null text holds none.
    """
    known = names.where(F.col("name") != "").select("name").distinct()
    return _by_automaton(rows, known) if known.limit(most + 1).count() <= most else _by_prefix(rows, known)


def match_regions(files: DataFrame, names: DataFrame, key: str = "filename", most: int = BROADCAST_NAMES) -> DataFrame:
    """files with region_code, matched (the name found) and n_names: the code of the longest name of names(name, code) in key.

    Names are compared in small letters. Of names of one length the first in the text counts, and of a name's codes the smallest.
    Where no name is found region_code is null and matched says that a person must choose.
    """
    codes = names.select(F.lower("name").alias("name"), "code").groupBy("name").agg(F.min("code").alias("code"))
    texts = files.select(F.lower(F.col(key)).alias("text")).where("text IS NOT NULL").distinct()
    found = find_names(texts.select(F.col("text").alias("row"), "text").select(F.xxhash64("row").alias("row"), "text"), codes, most)
    best = found.groupBy("row").agg(F.min(F.struct((-F.length("name")).alias("size"), "place", "name")).alias("x"), F.count("*").alias("n_names"))
    best = best.select("row", F.col("x.name").alias("name"), "n_names").join(codes, "name")
    out = files.withColumn("_row", F.xxhash64(F.lower(F.col(key)))).join(best.select(F.col("row").alias("_row"), F.col("name").alias("matched"), F.col("code").alias("region_code"), "n_names"), "_row", "left")
    return out.select(*files.columns, "region_code", F.coalesce("matched", F.lit(MANUAL)).alias("matched"), F.coalesce("n_names", F.lit(0)).cast("int").alias("n_names"))

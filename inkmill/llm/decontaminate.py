"""Benchmark decontamination: a prefix-filtered set join between item windows and documents.

A window is ``window`` consecutive words of an item (a shorter item is one window). A window is a set of
word shingles (five words, or the whole window if it is shorter), each at its offset. Containment of the whole
window is asked for, so the necessary prefix is one shingle: the window's rarest in the documents. Documents'
shingle positions are joined with item shingles in one pass, which also counts words; windows then join those occurrences on their rarest
shingle, length and position bounds drop starts that can't hold the window, and a window counts only if the
shingles that cover it all stand at their places, compared as strings.

Nulls and odd input: null text has no words, so it is never hit and an item with it has no window. A null
item_id hits words but is not named and not counted. Repeated document rows are judged each for itself,
repeated items count once by item_id. Very long texts cost in proportion. Extra columns of documents are not returned by ``overlaps`` and are kept by
``decontaminate``. Every step is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if, cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 5
#: Item shingles or windows up to this many rows are broadcast; beyond it the joins shuffle.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _shingles(w: Column, size: int) -> Column:
    """(pos, s): the shingles of a word array by position; an array shorter than size has none."""
    starts = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.concat_ws(" ", *(F.get(w, i + k) for k in range(size))).alias("s")))


def item_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """windows(wid, wlen, words) and owners(wid, item_id) of items(item_id, text)."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    span = F.least(F.lit(window), F.size("w"))
    at = w.select("item_id", "w", span.alias("wlen"), F.explode(F.sequence(F.lit(1), F.size("w") - span + 1)).alias("i"))
    each = at.select("item_id", "wlen", F.slice("w", F.col("i"), F.col("wlen")).alias("words"))
    each = each.withColumn("wid", F.sha2(F.array_join("words", " "), 256))
    return each.select("wid", "wlen", "words").distinct(), each.select("wid", "item_id").distinct()


def overlaps(documents: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per document row: doc_id, fp (hash of its text), n_words, n_hit, item_ids (sorted strings), n_items."""
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64("text").alias("fp")]
    windows, owners = (cut(x, "windows") for x in item_windows(items, window))
    parts = windows.withColumn("size", F.least(F.lit(shingle), F.col("wlen")))
    sizes = [r[0] for r in parts.select("size").distinct().collect()]  # at most `shingle` values
    one_size = lambda s: parts.where(F.col("size") == s).select("wid", "wlen", "size", F.inline(_shingles(F.col("words"), s))).withColumnRenamed("pos", "off")
    grams = windows.select("wid", "wlen", F.lit(0).alias("size"), F.lit(0).alias("off"), F.lit("").alias("s")).where("false")
    for s in sizes:
        grams = grams.unionByName(one_size(s))
    grams = cut(grams, "grams")
    # The empty shingle stands once in every document. Where the join shuffles, it is left out, as all rows would share it.
    distinct = grams.select("s").distinct().unionByName(windows.sparkSession.range(1).select(F.lit("").alias("s")))
    n_grams, n_windows, n_owners = distinct.count(), windows.count(), owners.count()

    # One pass over the documents: where item shingles stand. The shingle size is told by its word count.
    w = F.col("w")
    mark = F.array(F.struct(F.lit(0).alias("pos"), F.lit("").alias("s")))
    every = documents.select("doc_id", *key, words(F.col("text")).alias("w")).select("doc_id", "did", "fp", F.size(w).alias("nw"), F.inline(F.concat(*(_shingles(w, s) for s in sizes), mark)))
    if n_grams <= BROADCAST_ROWS:
        every = cut(every.join(F.broadcast(distinct), "s"), "occurrences")
        n_words = every.where("s = ''").select("doc_id", "did", "fp", F.col("nw").cast("long").alias("n_words"))
    else:
        every = cut(every.where("s <> ''").join(distinct, "s"), "occurrences")
        n_words = documents.select("doc_id", *key, F.size(words(F.col("text"))).cast("long").alias("n_words"))
    found = every.where("s <> ''").select("did", "fp", "nw", "pos", "s").distinct()

    rare = found.groupBy("s").agg(F.count("*").alias("df"))
    ranked = grams.join(rare, "s", "left")
    # A window with a shingle that stands nowhere (df 0) has no occurrence; that shingle is its prefix.
    prefix = ranked.groupBy("wid", "wlen").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "s", "off")).alias("p"))
    prefix = prefix.where("p.df > 0").select("wid", "wlen", F.col("p.s").alias("s"), F.col("p.off").alias("off"))
    starts = found.join(broadcast_if(prefix, n_windows, BROADCAST_ROWS), "s").select("did", "fp", "nw", "wid", "wlen", (F.col("pos") - F.col("off")).alias("start"))
    starts = starts.where((F.col("start") >= 0) & (F.col("start") + F.col("wlen") <= F.col("nw")))
    # The cover of a window: its first shingle, every size-th one after it, and its last.
    last = F.col("wlen") - F.col("size")
    cover = grams.where((F.col("off") % F.col("size") == 0) | (F.col("off") == last)).select("wid", "off", "s")
    n_cover = cover.groupBy("wid").agg(F.count("*").alias("need"))
    want = starts.join(broadcast_if(cover, n_windows, BROADCAST_ROWS // 4), "wid").withColumn("pos", F.col("start") + F.col("off"))
    have = want.join(found.select("did", "fp", "pos", "s"), ["did", "fp", "pos", "s"]).groupBy("did", "fp", "wid", "wlen", "start").agg(F.count("*").alias("n"))
    hits = cut(have.join(broadcast_if(n_cover, n_windows, BROADCAST_ROWS), "wid").where("n = need").select("did", "fp", "wid", "wlen", "start"), "hits")

    spans = hits.groupBy("did", "fp").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("wlen")).alias("end")))).alias("spans"))
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], x["end"]).alias("upto")),
        lambda a: a["n"],
    )
    named = hits.select("did", "fp", "wid").distinct().join(broadcast_if(owners, n_owners, BROADCAST_ROWS // 4), "wid")
    named = named.groupBy("did", "fp").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    per = spans.select("did", "fp", union.alias("n_hit")).join(named, ["did", "fp"], "left")
    none = F.array().cast("array<string>")
    return n_words.join(per, ["did", "fp"], "left").select(
        "doc_id",
        "fp",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
    )


def decontaminate(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of documents that hold no window of any item, with their own columns."""
    bad = overlaps(documents, items, window).where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")).distinct()
    return documents.join(bad, documents["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(documents["text"]) == bad["_fp"]), "left_anti")

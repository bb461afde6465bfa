"""Toxicity: class-conditional Kneser-Ney models of the characters of words, with shared backoff.

Two interpolated Kneser-Ney models, one of toxic and one of ordinary rows, give each word two log-likelihoods.
Their order-5 counts come from every labelled row of the training folds. Both back off to one shared
Kneser-Ney model of orders 5 to 1 (continuation counts below the highest) over every document, so an expression that
a class has hardly seen gets the shared estimate and tells little. Counts are exact and relational: each order is a table of
n-grams, joined to its contexts' sums and to the order below; what comes out is one log-likelihood ratio for each 5-gram of the
corpus, so the table grows with the corpus. It is broadcast while it has at most BROADCAST_GRAMS rows, and joined beyond.

A document has two statistics, both divided by its number of words: its toxic log-likelihood less its ordinary one, and the same
over its words' excess over MARGIN alone (logarithm), which the languages' unlike shares of the classes don't reach. A
logistic regression of both, on a bounded sample of a fold that the counts don't hold (``calibrate_rows``), gives the
probability. A text counts once however many labelled copies it has, by the share of their labels.

Nulls and odd input: null text, or text without letters and digits, has the smallest statistic. Null labels are ignored; rows
that repeat count as often as they stand. Without labels of both classes every score is 0.5 (no labels) or the
class's share. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if, columns, cut
from .quality import held_out
from .subwords import by_slices, code_points, coded, gram_hashes, sums

ORDER, DISCOUNT = 5, 0.75
#: Weight of the shared estimate in a class's distribution, in counts, beside the discounted mass.
PRIOR = 30.0
#: What a word's log-likelihood ratio has beyond this many nats is its excess.
MARGIN = 2.0
#: Added to the statistic before its logarithm is taken.
FLOOR = 1e-3
#: Log-likelihood ratios of n-grams up to this many rows are broadcast, 12 bytes each.
BROADCAST_GRAMS = 4_000_000
#: Characters that the shared model takes to exist.
ALPHABET = 4096
CALIBRATE_ROWS = 4000
PIECE = 20_000
#: Rows that a task scores at a time.
ROWS = 2500
LEFT, RIGHT = "<" * (ORDER - 1), ">"
#: Labels up to this many rows are broadcast to the documents.
BROADCAST_LABELS = 2_000_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def _padded_grams(word: Column) -> Column:
    """The n-grams of order ORDER of a word between its marks."""
    padded = F.concat(F.lit(LEFT), word, F.lit(RIGHT))
    return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))


def gram_ratios(counts: DataFrame) -> DataFrame:
    """(g, ratio) of every n-gram of order ORDER of counts(word, t, o, c): its toxic log-likelihood less its ordinary one."""
    top = cut(counts.select(F.explode(_padded_grams(F.col("word"))).alias("g"), "t", "o", "c").groupBy("g").agg(*(F.sum(x).alias(x) for x in "toc")), "grams")
    levels = [top.select("g", "c")]
    for n in range(ORDER - 1, 0, -1):
        # How many n-grams of the order above end in it.
        levels.insert(0, levels[0].select(F.substring("g", 2, n).alias("g")).groupBy("g").agg(F.count("*").alias("c")))
    total = F.broadcast(levels[0].agg(F.sum("c").alias("total")))  # one row
    p = levels[0].join(total, F.lit(True)).select("g", ((F.col("c") + 0.5) / (F.col("total") + 0.5 * ALPHABET)).alias("p"))
    for n in range(2, ORDER + 1):
        rows = levels[n - 1].withColumns({"context": F.substring("g", 1, n - 1), "shorter": F.substring("g", 2, n - 1)})
        sums_ = rows.groupBy("context").agg(F.sum("c").alias("total"), F.count("*").alias("types"))
        lower = p.select(F.col("g").alias("shorter"), F.col("p").alias("below"))
        joined = rows.join(sums_, "context").join(lower, "shorter")
        p = cut(joined.select("g", ((F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("types") * F.col("below")) / F.col("total")).alias("p")), "orders")
    rows = top.withColumn("context", F.substring("g", 1, ORDER - 1))
    sums_ = rows.groupBy("context").agg(*(F.sum(x).alias(f"{x}_total") for x in "to"), *(F.sum((F.col(x) > 0).cast("double")).alias(f"{x}_types") for x in "to"))
    both = rows.join(sums_, "context").join(p, "g")
    own = lambda x: (F.greatest(F.col(x) - DISCOUNT, F.lit(0.0)) + (DISCOUNT * F.col(f"{x}_types") + PRIOR) * F.col("p")) / (F.greatest(f"{x}_total", x) + PRIOR)
    return both.select("g", (F.log(F.greatest(own("t"), F.lit(1e-12))) - F.log(F.greatest(own("o"), F.lit(1e-12)))).alias("ratio"))


def _sorted_ratios(ratios: DataFrame) -> dict[str, np.ndarray]:
    """Hashes of the n-grams, ascending, and their ratios; at most BROADCAST_GRAMS rows."""
    rows = ratios.toArrow().combine_chunks()
    points = code_points(rows["g"].combine_chunks().cast(pa.string()), "", "")[0]
    hashes = gram_hashes(points, ORDER)[ORDER - 1][ORDER - 1 :: ORDER] if len(points) else np.empty(0, np.uint64)
    order = np.argsort(hashes)
    return {"hash": hashes[order], "ratio": rows["ratio"].to_numpy().astype(np.float32)[order]}


def word_ratios(vocabulary: pa.StringArray, table: dict[str, np.ndarray]) -> np.ndarray:
    """Each word's toxic log-likelihood less its ordinary one, from the table of its n-grams; unknown n-grams tell nothing."""
    out = np.zeros(len(vocabulary))
    for a in range(0, len(vocabulary) if len(table["hash"]) else 0, PIECE):
        points, off = code_points(vocabulary.slice(a, PIECE), LEFT, RIGHT)
        hashes = gram_hashes(points, ORDER)[-1]
        place = np.arange(len(points)) - np.repeat(off[:-1], np.diff(off))
        at = np.flatnonzero(place >= ORDER - 1)
        found = np.minimum(np.searchsorted(table["hash"], hashes[at]), len(table["hash"]) - 1)
        full = np.zeros(len(points))
        full[at] = np.where(table["hash"][found] == hashes[at], table["ratio"][found], 0)
        out[a : a + PIECE] = sums(full, off)
    return out


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", calibrate_rows: int = CALIBRATE_ROWS) -> dict:
    """Counts over all documents and all labelled rows of folds 1 to 3, calibration on rows of fold 4."""
    spark = documents.sparkSession
    known = cut(labels.select("doc_id", F.col(label).cast("int").alias("y")).where(~held_out(F.col("doc_id")) & F.col("y").isin(0, 1)), "known")
    n = known.count()
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    counted = known.where(fold < 4)
    # A text is counted at its smallest labelled doc_id, with the share of all its labels.
    texts = documents.select("doc_id", F.xxhash64("text").alias("fp")).join(broadcast_if(counted, n, BROADCAST_LABELS), "doc_id")
    shares = texts.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.avg("y").alias("t")).groupBy("doc_id").agg(F.avg("t").alias("t"))
    each = documents.select("doc_id", "text").join(broadcast_if(cut(shares, "shares"), n, BROADCAST_LABELS), "doc_id", "left")
    each = each.select(F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce(1 - F.col("t"), F.lit(0.0)).alias("o"), F.explode(words(F.col("text"))).alias("word"))
    counts = each.groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.count("*").alias("c"))
    model = {"ratios": cut(gram_ratios(counts), "ratios")}
    if model["ratios"].count() <= BROADCAST_GRAMS:
        model["sent"] = spark.sparkContext.broadcast(_sorted_ratios(model["ratios"]))
    # Class sizes differ, and so do the words per row; the calibration's constant takes both in.
    # The sample is drawn from the labels, so texts of other rows never move.
    chosen = F.broadcast(known.where(fold == 4).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(calibrate_rows))  # calibrate_rows rows
    sample = documents.select("doc_id", "text").join(chosen, "doc_id")
    rows = _statistics(sample, model, ["y"]).select("_doc.y", "_x").toPandas()
    x = np.array(rows["_x"].to_list(), np.float64).reshape(-1, 2)
    model["weights"] = _logistic(x, rows["y"].to_numpy(np.float64))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights of the columns of x and the constant of a lightly ridged logistic regression, by Newton's method."""
    width = x.shape[1]
    if len(y) == 0:
        return [0.0] * (width + 1)
    if y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return [0.0] * width + [float(np.log(share / (1 - share)))]
    scale = np.maximum(x.std(0), 1e-9)
    a, w = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(width + 1)
    ridge = np.array([1e-3] * width + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w = np.clip(w, -200, 200)
    return [*(w[:-1] / scale).tolist(), float(w[-1])]


def _statistic(sent) -> Callable[[Column], Column]:
    """The column function from a text to its two statistics."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(lists: pa.Array) -> pa.Array:
        return by_slices(some, lists, ROWS, pa.list_(pa.float64()))

    def some(lists: pa.Array) -> pa.Array:
        vocabulary, index, off = coded(lists)
        ratio = word_ratios(vocabulary, sent.value)
        of = lambda each: sums(each[index] if len(index) else np.empty(0), off) / np.maximum(np.diff(off), 1)
        both = np.stack([of(ratio), np.log(FLOOR + of(np.maximum(ratio - MARGIN, 0)))], 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, both.size + 1, 2), pa.int32()), pa.array(both.ravel()))

    return lambda text: run(words(text))


def _statistics(documents: DataFrame, model: dict, kept: list[str]) -> DataFrame:
    """_doc, a struct of the kept columns, and _x, the two statistics of every row's text. Nothing else is in the way of the caller's names."""
    own = F.struct(*columns(kept)).alias("_doc")
    if "sent" in model:
        return documents.select(own, _statistic(model["sent"])(F.col("text")).alias("_x"))
    # The table of n-grams is too large to send: texts meet it by joins, each different text and word once.
    texts = documents.select(F.xxhash64("text").alias("_fp"), "text").dropDuplicates(["_fp"])
    each = texts.select("_fp", F.explode(words(F.col("text"))).alias("word")).groupBy("_fp", "word").agg(F.count("*").alias("k"))
    grams = each.select("word").distinct().select("word", F.explode(_padded_grams(F.col("word"))).alias("g"))
    # A word whose n-grams are all unknown tells nothing, but counts.
    ratio = cut(grams.join(model["ratios"], "g", "left").groupBy("word").agg(F.coalesce(F.sum("ratio"), F.lit(0.0)).alias("ratio")), "words")
    excess = F.greatest(F.col("ratio") - MARGIN, F.lit(0.0))
    found = each.join(ratio, "word").groupBy("_fp").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("ratio")).alias("plain"), F.sum(F.col("k") * excess).alias("excess"))
    both = cut(found.select("_fp", F.array(F.col("plain") / F.col("n"), F.log(FLOOR + F.col("excess") / F.col("n"))).alias("_x")), "statistics")
    rows = documents.select(own, F.xxhash64("text").alias("_fp"))
    return rows.join(both, "_fp", "left").select("_doc", F.coalesce("_x", F.array(F.lit(0.0), F.log(F.lit(FLOOR)))).alias("_x"))


def _chance(model: dict) -> Column:
    a, b, constant = model["weights"]
    z = F.get("_x", F.lit(0)) * F.lit(float(a)) + F.get("_x", F.lit(1)) * F.lit(float(b)) + F.lit(float(constant))
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def score(documents: DataFrame, model: dict) -> DataFrame:
    """documents with score, the chance of label 1 of every row's whole text; a column score is replaced."""
    kept = [c for c in documents.columns if c.lower() != "score"]
    scored = _statistics(documents, model, kept).select("_doc.*", _chance(model).alias("score"))
    return scored if len(kept) == len(documents.columns) else scored.select(*columns(["score" if c.lower() == "score" else c for c in documents.columns]))


def accept(documents: DataFrame, labels: DataFrame, most: float) -> DataFrame:
    """The rows of documents that a model trained on labels gives a score below ``most``."""
    model = train(documents, labels)
    return _statistics(documents, model, documents.columns).where(_chance(model) < most).select("_doc.*")

"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax, SGD in numpy.

A token is a run of non-space characters as it stands; a token equal to the one before it adds the word pair
feature AGAIN. A token's vector is the mean of the vectors of its word hash and of its 2- to 5-character grams,
a document's the mean over its tokens, and two softmax outputs give the class.

The model is fitted on at most ``train_rows`` labels (those with the smallest hash of doc_id) whose texts have at most
``train_chars`` characters each and ``train_text`` together, by one task, whose memory that bounds; scoring reads every whole text. As softmax of a mean
is a function of the mean of scalars, scoring needs one scalar a distinct token.

Nulls and odd input: null or empty text has a zero vector and gets the bias's score. Null labels and labels of
absent documents are ignored; repeated rows count as often as they stand. With no usable labels, or one class
only, every score is that class's share (0.5 without labels). Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .subwords import by_slices, code_points, coded, gram_hashes, sums

BUCKETS, DIM, GRAMS = 1 << 17, 8, (2, 3, 4, 5)
TRAIN_ROWS, TRAIN_CHARS, TRAIN_TEXT = 4000, 20_000, 24_000_000
EPOCHS, BATCH, RATE = 6, 32, 0.5
AGAIN = BUCKETS - 1
#: Distinct tokens worked on at a time, which bounds a task's memory.
PIECE = 40_000
#: Rows that a task scores at a time.
ROWS = 2500


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def token_features(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each word, flat, and offsets: its own hash, then those of its character grams."""
    points, off = code_points(words, "<", ">")
    owner = np.repeat(np.arange(len(words)), np.diff(off))
    place = np.arange(len(points)) - off[:-1][owner]
    hashes = gram_hashes(points, max(GRAMS))
    # A word's own hash folds all its code points in, weighted by place.
    weights = hashes[0] * ((place.astype(np.uint64) << np.uint64(1)) + np.uint64(1))
    whole = np.add.reduceat(weights, off[:-1]) if len(words) else weights
    ids, owners = [whole % np.uint64(BUCKETS - 1)], [np.arange(len(words))]
    for n in GRAMS:
        ok = place >= n - 1
        ids.append(hashes[n - 1][ok] % np.uint64(BUCKETS - 1))
        owners.append(owner[ok])
    ids, owners = np.concatenate(ids).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order], np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(words)))])


def _weighted_features(words: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each row's distinct features and their weights in its mean."""
    vocabulary, index, off = coded(words)
    ids, size = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for a in range(0, len(vocabulary), PIECE):
        feature, ends = token_features(vocabulary.slice(a, PIECE))
        ids.append(feature.astype(np.int32))
        size.append(np.diff(ends))
    ids, size = np.concatenate(ids), np.concatenate(size)
    begins = np.concatenate([[0], np.cumsum(size)])
    rows = []
    for a, b in zip(off[:-1], off[1:], strict=True):
        token, count = np.unique(index[a:b], return_counts=True)
        again = int((index[a + 1 : b] == index[a : b - 1]).sum()) if b > a else 0
        at = np.arange(size[token].sum()) + np.repeat(begins[token] - (np.cumsum(size[token]) - size[token]), size[token])
        total = np.bincount(ids[at], np.repeat(count / size[token], size[token]), BUCKETS)
        total[AGAIN] += again
        features = np.flatnonzero(total)
        rows.append((features.astype(np.int32), (total[features] / max(b - a + again, 1)).astype(np.float32)))
    return rows


def fit(words: pa.ListArray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> dict[str, np.ndarray]:
    """Vectors, outputs and bias from token lists and 0/1 labels, by stochastic gradient descent."""
    weighted = _weighted_features(words)
    rng = np.random.default_rng(seed)
    vectors, outputs = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), np.zeros((DIM, 2))
    share = np.clip(labels.mean(), 0.02, 0.98)
    bias = np.log(np.array([1 - share, share]))
    outputs[:] = rng.normal(0, 0.1, outputs.shape)
    steps, step = epochs * -(-len(labels) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            docs = order[at : at + BATCH]
            rows = [weighted[d] for d in docs]
            mean = np.stack([w @ vectors[f] for f, w in rows])
            logit = mean @ outputs + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), labels[docs]] -= 1
            back = (p @ outputs.T) * (rate * 10)
            outputs -= rate * mean.T @ p
            bias = bias - rate * 0.1 * p.mean(0)
            for (f, w), g in zip(rows, back, strict=True):
                vectors[f] -= w[:, None] * g  # a row's features are distinct
    return {"scalar": (vectors @ (outputs[:, 1] - outputs[:, 0])).astype(np.float32), "bias": np.float64(bias[1] - bias[0])}


def score_lists(words: pa.ListArray, model: dict[str, np.ndarray]) -> np.ndarray:
    vocabulary, index, off = coded(words)
    scalar = model["scalar"].astype(np.float64)
    each = np.empty(len(vocabulary))
    for a in range(0, len(vocabulary), PIECE):
        ids, ends = token_features(vocabulary.slice(a, PIECE))
        each[a : a + PIECE] = sums(scalar[ids], ends) / np.diff(ends)
    again = np.zeros(len(index))
    again[1:] = index[1:] == index[:-1]
    again[off[:-1][off[:-1] < len(index)]] = 0
    n = np.diff(off) + sums(again, off)
    mean = (sums(each[index] if len(index) else np.empty(0), off) + sums(again, off) * scalar[AGAIN]) / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(mean + model["bias"], -30, 30)))


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), F.array().cast("array<string>"))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS, train_text: int = TRAIN_TEXT) -> dict[str, np.ndarray]:
    """A model from labels(doc_id, label) outside the held-out fold; the bounds are documented parameters."""
    known = labels.select("doc_id", F.col(label).alias("y")).where(~held_out(F.col("doc_id")) & F.col("y").isin(0, 1))
    # The sample is drawn from the labels, so texts of other rows never move.
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(train_rows))  # train_rows rows
    sample = documents.select("doc_id", "text").where(F.length("text") <= train_chars).join(chosen, "doc_id")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "y", F.xxhash64("text")).limit(train_rows)
    # One task fits the model: the sample stays on the executors, and only the weights come to the driver.
    found = sample.select(tokens(F.col("text")).alias("w"), F.col("y").cast("long").alias("y"), F.length("text").alias("n")).coalesce(1).mapInArrow(partial(_fitted, train_text), "scalar binary, bias double").first()
    if found is None:  # no labels, and so no task
        return {"scalar": np.zeros(BUCKETS, np.float32), "bias": np.float64(0)}
    return {"scalar": np.frombuffer(found["scalar"], np.float32), "bias": np.float64(found["bias"])}


def _fitted(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows (w, y, n) whose lengths n add up to at most ``most``, as one row."""
    parts = list(batches)
    y, n = (np.concatenate([np.empty(0, np.int64), *(b.column(k).to_numpy() for b in parts)]) for k in (1, 2))
    y = y[np.cumsum(n) <= most]
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        model = {"scalar": np.zeros(BUCKETS, np.float32), "bias": np.log(max(share, 1e-3) / max(1 - share, 1e-3))}
    else:
        model = fit(pa.concat_arrays([b.column(0) for b in parts]).slice(0, len(y)), y)
    del parts
    pa.default_memory_pool().release_unused()
    yield pa.RecordBatch.from_arrays([pa.array([model["scalar"].tobytes()], pa.binary()), pa.array([float(model["bias"])])], ["scalar", "bias"])


def chance(spark: SparkSession, model: dict[str, np.ndarray], text: Column) -> Column:
    """The chance of label 1 of a whole text."""
    sent = spark.sparkContext.broadcast(model)  # BUCKETS floats

    @F.arrow_udf(T.DoubleType())
    def run(words: pa.Array) -> pa.Array:
        return by_slices(lambda some: pa.array(score_lists(some, sent.value)), words, ROWS, pa.float64())

    return run(tokens(text))


def score(documents: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """documents with score, the chance of label 1 of every row's whole text; a column score is replaced."""
    return documents.withColumn("score", chance(documents.sparkSession, model, F.col("text")))


def accept(documents: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """The rows of documents that a model trained on labels gives at least this score."""
    return documents.where(chance(documents.sparkSession, train(documents, labels), F.col("text")) >= least)

"""Vectors for texts: any embedder called in batches, row by row aligned, and a hashed projection that needs none."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}]+"
DIMENSIONS, BATCH, RETRIES = 64, 32, 2


class EmbeddingError(RuntimeError):
    """An embedder's reply that doesn't fit its texts."""


def _checked(texts: list[str], reply: object) -> list[list[float]]:
    if not isinstance(reply, list) or len(reply) != len(texts):
        raise EmbeddingError(f"{len(texts)} texts, {len(reply) if isinstance(reply, list) else 'no'} vectors")
    if len({len(v) if v is not None else -1 for v in reply} | {-1}) > 2 or any(v is None or not len(v) or not all(x is not None and np.isfinite(x) for x in v) for v in reply):
        raise EmbeddingError("a vector is missing, ragged or not finite")
    return reply


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "text", into: str = "embedding", batch: int = BATCH, retries: int = RETRIES, wait: float = 1.0) -> DataFrame:
    """rows with ``into``, the embedder's vector of each row's text; a null text has a null vector and isn't sent.

    A call that raises, or whose reply has not one finite vector of one length for each text, is made again ``retries`` times; then the job
    fails, so no row is ever left without its vector or given another's.
    """
    own = [c for c in rows.columns if c != into]
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in own]
    made = rows.select(F.struct(*quoted).alias("row"), F.col("`" + text.replace("`", "``") + "`").cast("string").alias("text"))

    def call(texts: list[str]) -> list[list[float]]:
        for attempt in range(retries + 1):
            try:
                return _checked(texts, embedder(texts))
            except Exception:
                if attempt == retries:
                    raise
                time.sleep(wait * 2**attempt)
        raise AssertionError

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            full, vectors = [k for k, t in enumerate(texts) if t is not None], [None] * len(texts)
            for k in range(0, len(full), batch):
                for at, v in zip(full[k : k + batch], call([texts[j] for j in full[k : k + batch]]), strict=True):
                    vectors[at] = v
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float32()))], ["row", "v"])

    schema = T.StructType([T.StructField("row", made.schema["row"].dataType), T.StructField("v", T.ArrayType(T.FloatType()))])
    return made.mapInArrow(run, schema).select("row.*", F.col("v").alias(into))


def hash_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A text's words counted in ``dimensions`` places with signs, both told by a word's digest; a null text has zeros."""
    number = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long")
    words = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    codes = F.transform(words, lambda w: (number(w) % (2 * dimensions)).cast("int"))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def counted(lists: pa.Array) -> pa.Array:
        off = lists.offsets.to_numpy().astype(np.int64)
        flat, off = lists.values[off[0] : off[-1]].to_numpy(zero_copy_only=False).astype(np.int64), off - off[0]
        row = np.repeat(np.arange(len(lists)), np.diff(off))
        sums = np.bincount(row * dimensions + flat % dimensions, np.where(flat >= dimensions, 1.0, -1.0), len(lists) * dimensions)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(sums) + 1, dimensions), pa.int32()), pa.array(sums))

    return counted(codes)

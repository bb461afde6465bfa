"""Words as code points, and hashes of their character n-grams, for whole Arrow batches at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(77)  # fixed: hashes must agree between tasks
ODD = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def code_points(words: pa.StringArray, left: str, right: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between left and right, and where each word begins (with the end last)."""
    text = "".join(f"{left}{w}{right}" for w in words.to_pylist())
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False) + len(left) + len(right)
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def gram_hashes(points: np.ndarray, most: int, seed: int = 0) -> list[np.ndarray]:
    """For n = 1..most, a 64-bit hash of the n code points that end at each position; the first n-1 are unused."""
    out, total = [], np.zeros(len(points), np.uint64)
    for n in range(1, most + 1):
        total[n - 1 :] += points[: len(points) - n + 1] * ODD[n]
        out.append(mix(total + ODD[n + seed]))
    return out


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive offsets; an empty range has 0."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def coded(words: pa.ListArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Distinct words of a list column, each occurrence's number among them, and the rows' offsets."""
    off = words.offsets.to_numpy()
    flat = words.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
    return flat.dictionary.cast(pa.string()), flat.indices.to_numpy(zero_copy_only=False), off - off[0]


def in_slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches a few rows at a time, which bounds a task's memory; what a slice took is given back before the next."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
            pa.default_memory_pool().release_unused()


def by_slices(work: Callable[[pa.Array], pa.Array], column: pa.Array, rows: int, kind: pa.DataType) -> pa.Array:
    """work over a column a few rows at a time."""
    made = [pa.array([], kind)]
    for k in range(0, len(column), rows):
        made.append(work(column.slice(k, rows)))
        pa.default_memory_pool().release_unused()
    return pa.concat_arrays(made)

"""Token ids in a Re-Pair compressed file format, with random access.

``write_ids`` encodes whole texts with a tokenizer file of the tokenizers library, ends each document with an end id,
and writes the ids in ascending doc_id order (null first) as a Parquet table of shards. A shard is compressed by Re-Pair:
in each round frequent pairs of neighbouring symbols are replaced by new symbols, until no pair stands LEAST_COUNT times.
It stores the rules, the length each rule expands to, the documents' lengths, and every BLOCK symbols the ids before them, so a
range of ids is decoded from the blocks that overlap it alone (``Shard.ids``). Symbols take three bytes if they can.
``read_ids`` gives the documents back.

A tokenizer that lowers case, splits at white space and parts letters from marks encodes a text as it encodes its
words, so each different one is encoded once. ``per_word=False`` turns that off for other tokenizers.

Nulls and odd input: null text is empty and holds the end id alone. Rows that repeat a doc_id follow each other, ordered by
text. Empty tables give empty tables. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAGIC = b"RPR2"
#: Ids a shard holds at least (the last shard of a part holds what is left); documents are never divided.
SHARD_IDS = 1 << 18
LEAST_COUNT = 8
#: Symbols between two stored places.
BLOCK = 1024
#: Nonterminals are numbered from here; ids must be smaller.
BASE = 1 << 24
#: Words whose ids a Python worker keeps.
CACHE_WORDS = 700_000
SHARD_SCHEMA = "part int, seq int, before long, n_docs int, n_ids long, shard binary"

_LETTERS_AND_MARKS = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿĀ-ſ]+)(?P<mark>[.,;:!?|]*)$"

_BETWEEN = "~"

_cache: dict = {}


NONE = np.int32(np.iinfo(np.int32).max)


def _candidates(x: np.ndarray, least: int) -> np.ndarray:
    """Where pairs stand whose hashed slot is hit ``least`` times: all that can be frequent, and a few others."""
    bits = max(10, int(len(x)).bit_length())
    slot = (((x[:-1] * np.uint32(0x9E3779B1)) ^ (x[1:] * np.uint32(0x85EBCA77))) >> np.uint32(32 - bits)).astype(np.intp)
    return np.flatnonzero((np.bincount(slot, minlength=1 << bits) >= least)[slot])


def _ranked(x: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """For each pair of neighbours its rank among those that stand ``least`` times at the places at, most frequent first, or NONE."""
    out = np.full(len(x) - 1, NONE)
    key, index, count = np.unique(x[at].astype(np.uint64) << np.uint64(32) | x[at + 1], return_inverse=True, return_counts=True)
    often = np.flatnonzero(count >= least)
    rank = np.full(len(key), NONE)
    rank[often[np.argsort(-count[often], kind="stable")]] = np.arange(len(often))
    out[at] = rank[index]
    return out


def compress(ids: np.ndarray, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, lengths): rules[k] are the two symbols of nonterminal BASE + k, lengths[k] its expansion's length."""
    x, rules, lengths = ids.astype(np.uint32), np.empty((0, 2), np.uint32), np.empty(0, np.int64)
    at = _candidates(x, least) if len(x) > 1 else np.empty(0, np.intp)
    while len(at):
        r = _ranked(x, at, least)
        # Of pairs that overlap the more frequent one is replaced; of a run of one symbol every second pair.
        ranked = np.flatnonzero(r < NONE)
        padded = np.concatenate([[NONE], r, [NONE]])
        own, left, right = r[ranked], padded[ranked], padded[ranked + 2]
        begin = np.maximum.accumulate(np.where(own != left, np.arange(len(ranked)), 0))
        even = (np.arange(len(ranked)) - begin) % 2 == 0
        taken = ranked[((own < left) | ((own == left) & even)) & (own <= right)]
        if not len(taken):
            break
        place = np.full(int(r[taken].max()) + 1, -1)
        place[r[taken]] = taken  # where each pair that is replaced stands
        first = place[place >= 0]
        number = (np.cumsum(place >= 0) - 1)[r[taken]]
        new = np.stack([x[first], x[first + 1]], 1)
        size = np.ones((len(new), 2), np.int64)
        wide = new >= BASE
        size[wide] = lengths[new[wide] - np.uint32(BASE)]
        made = len(rules)
        rules, lengths = np.concatenate([rules, new]), np.concatenate([lengths, size.sum(1)])
        x[taken] = (BASE + made + number).astype(np.uint32)
        # Pairs that can be frequent now: those that were and still stand, and those of a new symbol.
        live, keep = np.zeros(len(x), bool), np.ones(len(x), bool)
        live[ranked], keep[taken + 1] = True, False
        live[taken] = True
        live[np.maximum(taken - 1, 0)] = True
        before = taken[(taken > 1)] - 2
        live[before[~keep[before + 1]]] = True  # the symbol before the new one, where it is new itself
        x, live = x[keep], live[keep]
        at = np.flatnonzero(live[:-1])
    return x, rules, lengths


def expand(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for: rules are expanded level by level, and symbols then take what their rules stand for."""
    flat, size = np.arange(BASE, BASE + len(rules), dtype=np.uint32), np.ones(len(rules), np.int64)
    while len(flat) and (wide := flat >= BASE).any():
        ends = np.cumsum(1 + wide)
        out = np.empty(ends[-1], np.uint32)
        at, pair = ends - 1 - wide, rules[flat[wide] - np.uint32(BASE)]
        out[at[~wide]] = flat[~wide]
        out[at[wide]], out[at[wide] + 1] = pair[:, 0], pair[:, 1]
        size = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(size)])])
        flat = out
    wide = symbols >= BASE
    rule = symbols[wide] - np.uint32(BASE)
    each = np.ones(len(symbols), np.int64)
    each[wide] = size[rule]
    ends = np.cumsum(each)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint32)
    out[ends[~wide] - 1] = symbols[~wide]
    begins = np.cumsum(size) - size
    n = size[rule]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(ends[wide] - n, n) + step] = flat[np.repeat(begins[rule], n) + step]
    return out


def _stored(symbols: np.ndarray, top: int, width: int) -> bytes:
    """Symbols with nonterminals numbered from top, in width bytes each."""
    wide = symbols >= BASE
    out = symbols.astype("<u4")
    out[wide] = symbols[wide] - np.uint32(BASE - top)
    return out.view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _loaded(data: np.ndarray, top: int) -> np.ndarray:
    """The symbols of rows of bytes."""
    out = np.zeros((len(data), 4), np.uint8)
    out[:, : data.shape[1]] = data
    out = out.view("<u4").ravel()
    out[out >= top] += np.uint32(BASE - top)
    return out


class Shard:
    """A shard's bytes, opened."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        docs, rules, symbols, self.top, width = (int(v) for v in np.frombuffer(data, "<i8", 5, 4))
        blocks, at = -(-symbols // BLOCK), 44
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.has_id = np.frombuffer(data, "u1", docs, at := at + 8 * docs).astype(bool)
        self.ends = np.cumsum(np.frombuffer(data, "<i8", docs, at := at + docs))
        self.lengths = np.frombuffer(data, "<i8", rules, at := at + 8 * docs)
        self.places = np.frombuffer(data, "<i8", blocks, at := at + 8 * rules)
        self.rules = _loaded(np.frombuffer(data, "u1", 2 * rules * width, at := at + 8 * blocks).reshape(-1, width), self.top).reshape(-1, 2)
        self.symbols = np.frombuffer(data, "u1", symbols * width, at + 2 * rules * width).reshape(-1, width)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    @staticmethod
    def pack(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
        symbols, rules, lengths = compress(ids)
        top = int(ids.max()) + 1 if len(ids) else 0
        width = 3 if top + len(rules) < 1 << 24 else 4
        each = np.ones(len(symbols), np.int64)
        wide = symbols >= BASE
        each[wide] = lengths[symbols[wide] - np.uint32(BASE)]
        places = (np.cumsum(each) - each)[::BLOCK]
        head = np.array([len(doc_ids), len(rules), len(symbols), top, width], "<i8")
        named = np.array([d or 0 for d in doc_ids], "<i8")
        parts = (head, named, np.array([d is not None for d in doc_ids], "u1"), sizes.astype("<i8"), lengths.astype("<i8"), places.astype("<i8"))
        return MAGIC + b"".join(p.tobytes() for p in parts) + _stored(rules.ravel(), top, width) + _stored(symbols, top, width)

    def all_ids(self) -> np.ndarray:
        return expand(_loaded(self.symbols, self.top), self.rules)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard, from the blocks of symbols that overlap the range."""
        if start >= stop or not len(self.places):
            return np.empty(0, np.uint32)
        a, b = np.searchsorted(self.places, start, "right") - 1, np.searchsorted(self.places, stop, "left")
        skip = start - int(self.places[a])
        return expand(_loaded(self.symbols[a * BLOCK : b * BLOCK], self.top), self.rules)[skip : skip + stop - start]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def _tokenizer(path: str):
    if _cache.get("path") != path:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        _cache.clear()
        t = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        _cache.update(path=path, tokenizer=t, words=pa.array([], pa.string()), flat=np.empty(0, np.uint32), off=np.zeros(1, np.int64))
    return _cache["tokenizer"]


def _library(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    found = [e.ids for e in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
    return np.array([i for ids in found for i in ids], np.uint32), np.fromiter(map(len, found), np.int64, len(found))


def _library_words(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words without white space: many in one text, with a mark between them that none of them holds."""
    mark = _tokenizer(path).encode(_BETWEEN, add_special_tokens=False).ids
    apart = pc.match_substring(words, _BETWEEN).to_numpy(zero_copy_only=False)
    if len(mark) != 1 or apart.any() or not len(words):
        plain = np.flatnonzero(~apart) if len(mark) == 1 else np.empty(0, np.int64)
        other = np.setdiff1d(np.arange(len(words)), plain)
        ids, sizes = _library(words.take(pa.array(other)).to_pylist(), path)
        if len(plain):
            more, more_sizes = _library_words(words.take(pa.array(plain)), path)
            ids, sizes, other = np.concatenate([ids, more]), np.concatenate([sizes, more_sizes]), np.concatenate([other, plain])
        return _gather(ids, np.concatenate([[0], np.cumsum(sizes)]), np.argsort(other, kind="stable"))
    listed = words.to_pylist()
    ids, _ = _library([f" {_BETWEEN} ".join([*listed[k : k + 500], ""]) for k in range(0, len(listed), 500)], path)
    stop = ids == mark[0]
    return ids[~stop], np.diff(np.flatnonzero(stop), prepend=-1) - 1


def _gather(flat: np.ndarray, off: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered by index, one after another, and their sizes."""
    size = np.diff(off)[index]
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(off[:-1][index] - ends + size, size)
    return flat[at], size


def encode_texts(texts: pa.Array, path: str, per_word: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and how many each has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not per_word:
        return _library(texts.to_pylist(), path)
    _tokenizer(path)
    words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    flat = words.flatten().dictionary_encode()
    spelled, index = flat.dictionary.cast(pa.string()), flat.indices.to_numpy(zero_copy_only=False)
    # Letters and the marks after them are separate tokens, and A-Z are lowered alone: parts are fewer than words.
    split = pc.extract_regex(spelled, _LETTERS_AND_MARKS)
    stem = pc.coalesce(pc.struct_field(split, "stem"), spelled)
    stem = pc.if_else(pc.and_(pc.is_valid(split), pc.string_is_ascii(stem)), pc.ascii_lower(stem), stem)
    mark = pc.coalesce(pc.struct_field(split, "mark"), pa.scalar(""))
    parts = pa.concat_arrays([stem, mark]).dictionary_encode()
    vocabulary, part = parts.dictionary, parts.indices.to_numpy(zero_copy_only=False)
    known = pc.index_in(vocabulary, value_set=_cache["words"])
    new = vocabulary.filter(pc.is_null(known))
    ids, sizes = _library_words(new, path)
    # The kept parts and the new ones in one table; vocabulary[k] is its row place[k].
    all_flat = np.concatenate([_cache["flat"], ids])
    all_off = np.concatenate([_cache["off"], _cache["off"][-1] + np.cumsum(sizes)])
    place = known.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    place[place < 0] = len(_cache["words"]) + np.arange(len(new))
    pairs = place[part].reshape(2, -1).T.ravel()
    word_flat, size = _gather(all_flat, all_off, pairs)
    word_off = np.concatenate([[0], np.cumsum(size)])[::2]
    out, size = _gather(word_flat, word_off, index)
    if len(_cache["words"]) + len(new) <= CACHE_WORDS:
        _cache.update(words=pa.concat_arrays([_cache["words"], new]), flat=all_flat, off=all_off)
    total = np.concatenate([[0], np.cumsum(size)])
    off = words.offsets.to_numpy()
    return out, total[off[1:]] - total[off[:-1]]


def write_ids(documents: DataFrame, path: str, tokenizer: str, end_id: int = 1, per_word: bool = True) -> None:
    """Write documents(doc_id, text) as shards under path; part numbers follow doc_id order."""
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, before, names, held, sizes, waiting
            row = [[part], [seq], [before], [len(names)], [waiting], [Shard.pack(names, np.concatenate(sizes), np.concatenate(held))]]
            seq, before = seq + 1, before + waiting
            names, held, sizes, waiting = [], [], [], 0
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["part", "seq", "before", "n_docs", "n_ids", "shard"])

        for b in batches:
            # Texts of about 32 MB at a time keep a task's memory bounded.
            cuts = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)) // (32 << 20)
            edges = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                ids, size = encode_texts(b.column(1).slice(lo, hi - lo), tokenizer, per_word)
                ended = np.full(len(ids) + len(size), end_id, np.uint32)
                ended[np.arange(len(ids)) + np.repeat(np.arange(len(size)), size)] = ids
                size, doc = size + 1, b.column(0).slice(lo, hi - lo).to_pylist()
                total, k = np.concatenate([[0], np.cumsum(size)]), 0
                while k < len(doc):
                    # As many documents as fill the shard.
                    stop = min(int(np.searchsorted(total, total[k] + SHARD_IDS - waiting, "left")), len(doc))
                    stop = max(stop, k + 1)
                    names += doc[k:stop]
                    sizes.append(size[k:stop])
                    held.append(ended[total[k] : total[stop]])
                    waiting += int(total[stop] - total[k])
                    k = stop
                    if waiting >= SHARD_IDS:
                        yield flush()
        if names:
            yield flush()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32, and ids on request."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # One row a part; parts are as many as the writer's shuffle had.
    ends = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                s = Shard(data)
                ids, ends = s.all_ids().astype("<u4"), s.ends
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), s.sizes.tolist(), strict=True)]
                columns = [pa.array(np.full(len(ends), part, np.int32)), pa.array(s.doc_ids, pa.int64(), mask=~s.has_id), pa.array(before + ends - s.sizes), pa.array(s.sizes.astype(np.int64)), pa.array(crc, pa.int64())]
                names = ["part", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    docs = shards.select("part", "before", "shard").mapInArrow(run, schema).join(F.broadcast(bases), "part")
    return docs.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))

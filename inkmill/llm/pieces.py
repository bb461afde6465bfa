"""SentencePiece encoding and decoding by a relational lattice.

``piece_table`` reads a model file. ``encode_words`` explodes each distinct word into substrings as long as the
longest piece, joins them to the piece table, groups the edges by word and folds them:
for a unigram model the fold is Viterbi's best path, with Spark's ``aggregate``; a BPE model is decoded by applying its merges, best score
first and leftmost first, over the same edges, as a path of best total score is not what such a model encodes: a round merges the first edge
that is ready in each word of an Arrow batch. Words beyond FOLD_CHARS characters are folded by the same rule one by one, in n log n steps.

Texts are cut into words where no piece can span: before a word mark (▁), around characters that stand in
no longer piece, and between letters and other characters if no piece mixes them. Distinct words of all documents are
encoded once. The HOT_WORDS most frequent ones (a bounded table) are looked up in the task that reads a document; the rest
are joined by word.

Nulls and odd input: null or empty text has no pieces. Characters without a piece become byte pieces, or the unknown
piece if the model has none. Rows that repeat stay repeated, and extra columns are kept whatever their names. Very long texts are cut in slices of a batch, very long words folded in n log n
steps. Of merges with the same score the leftmost goes first. Empty tables give empty tables. The model must not
rewrite characters (identity normalization) and must escape spaces and keep repeated ones; other models are refused.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, forget, release, scratch, small_batches
from .subwords import coded

MARK = "▁"
HOT_WORDS, FOLD_CHARS = 1 << 19, 32
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
PARTITION_WORDS = 20_000
HASH_LIMIT, HASHED_WORDS = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", 100_000
#: How a code point is spelled in a pattern of Python's and in one of Arrow's.
PYTHON_CODE, ARROW_CODE = r"\U%08X", r"\x{%X}"
#: Bytes of text that a task cuts at a time, and words that it then numbers or spells, which bound its memory.
TEXT_BYTES, WORDS = 4 << 20, 1 << 18
#: Words that are hashed at a time.
HASHED = 1 << 15
#: Stands for a rare word among the numbers of frequent words, which begin at 1.
GAP = 0
#: Seconds that listeners are given to let go of a job's plan.
LISTENERS = 2
#: A short word's edge as one long: rank, start, end and id, so that longs sort as merges go.
RANK, START, END = 36, 30, 24


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def read_model(path: str) -> dict:
    """pieces (piece, id, score, kind), and whether it is a BPE model."""
    with open(path, "rb") as f:
        top = list(_fields(f.read()))
    pieces = []
    for k, raw in enumerate(v for f, v in top if f == 1):
        part = dict(_fields(raw))
        pieces.append((part[1].decode(), k, float(np.frombuffer(part.get(2, b"\0\0\0\0"), "<f4")[0]), part.get(3, NORMAL)))
    trainer = dict(_fields(next(v for f, v in top if f == 2)))
    norm = dict(_fields(next((v for f, v in top if f == 3), b"")))
    if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1) or trainer.get(3, 1) not in (1, 2) or any(p[3] == USER for p in pieces) or not norm.get(3, 1):
        raise ValueError("only identity-normalized unigram and BPE models that keep spaces and put one in front are supported")
    return {"pieces": pieces, "bpe": trainer.get(3, 1) == 2}


def _ranges(chars: list[str]) -> list[tuple[int, int]]:
    """Runs of consecutive code points."""
    out: list[tuple[int, int]] = []
    for c in sorted(map(ord, chars)):
        out = [*out[:-1], (out[-1][0], c)] if out and out[-1][1] == c - 1 else [*out, (c, c)]
    return out


def word_classes(pieces: list[tuple], code: str = r"\x{%X}") -> list[str]:
    """The characters that words of several characters are made of, as one or two character classes."""
    many = [p[0] for p in pieces if p[3] == NORMAL and len(p[0]) > 1]
    if any(MARK in p.lstrip(MARK) for p in many):
        raise ValueError("a piece has a word mark after another character")
    joined = sorted(set("".join(many)) - {MARK})
    letters, others = [c for c in joined if c.isalpha()], [c for c in joined if not c.isalpha()]
    if any(len({c.isalpha() for c in p.lstrip(MARK)}) > 1 for p in many):
        letters, others = joined, []
    spell = lambda group: "".join(code % a if a == b else f"{code % a}-{code % b}" for a, b in _ranges(group))
    return [f"[{spell(group)}]" for group in (letters, others) if group]


def word_pattern(pieces: list[tuple], code: str = r"\x{%X}") -> str:
    """A pattern whose matches, one after another, are the words of a marked text; code spells a code point."""
    return "|".join([*(f"{MARK}*{group}+" for group in word_classes(pieces, code)), f"{MARK}+", f"(?s:[^{MARK}])"])


def piece_table(spark: SparkSession, model: dict) -> DataFrame:
    """(piece, id, score, rank) of the normal pieces; the row of the empty piece keeps words without edges."""
    normal = [p for p in model["pieces"] if p[3] == NORMAL]
    order = {s: k for k, s in enumerate(sorted({p[2] for p in normal}, reverse=True))}
    rows = pd.DataFrame([("", -1, 0.0, -1), *((p[0], p[1], p[2], order[p[2]]) for p in normal)], columns=["piece", "id", "score", "rank"])
    return spark.createDataFrame(rows, "piece string, id int, score double, rank int")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row, wherever body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _merged(owner: np.ndarray, edges: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The boundaries, as bits, that all merges of a BPE model leave of words of so many characters; and which edges are pieces then.

    Edges are packed, in the order of merging within their words. One can be merged if its ends are boundaries and one boundary is
    between them; each round merges the first such edge of every word.
    """
    s, e = np.int64(1) << (edges >> START & 63), np.int64(1) << (edges >> END & 63)
    # Bits of an edge's ends, and of the places between.
    ends, inner = s | e, e - s - s
    bits = (np.int64(1) << (chars + 1)) - 1
    own, out, within = owner, ends, inner
    while len(own):
        b = bits[own]
        left = b & within
        # An edge is done with once one of its ends is no boundary any more, or no boundary is left inside.
        live = (b & out == out) & (left != 0)
        own, out, within, left = own[live], out[live], within[live], left[live]
        ready = np.flatnonzero(left & (left - 1) == 0)
        first = ready[np.diff(own[ready], prepend=-1) > 0]
        bits[own[first]] &= ~within[first]
        # A word without such an edge is done with, too.
        more = np.zeros(len(bits), bool)
        more[own[first]] = True
        own, out, within = (x[more[own]] for x in (own, out, within))
    b = bits[owner]
    return bits, (b & ends == ends) & (b & inner == 0)


def _merge_ids(words: pa.Array, lists: pa.Array, single: np.ndarray, ids: np.ndarray, bytes_at: int | None, unk: int) -> pa.ListArray:
    """The ids of words of up to FOLD_CHARS characters by their packed edges; single are the code points with a piece of their own, ids theirs."""
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    bits, piece = _merged(owner, flat, chars)
    flat, owner = flat[piece], owner[piece]
    # Characters left alone: their own pieces, or their bytes.
    at, place = np.nonzero((bits[:, None] >> np.arange(FOLD_CHARS) & 3) == 3)
    code = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4")[(np.cumsum(chars) - chars)[at] + place]
    known = np.minimum(np.searchsorted(single, code), max(len(single) - 1, 0))
    has = single[known] == code if len(single) else np.zeros(len(code), bool)
    lost, which = np.unique(code[~has], return_inverse=True)
    spelled = [[unk] if bytes_at is None else [bytes_at + x for x in chr(c).encode()] for c in lost.tolist()]
    listed, begins = _gather(np.array([i for x in spelled for i in x], np.int64), np.cumsum([0, *map(len, spelled)]), which.reshape(-1))
    times = np.diff(begins)
    owners = np.concatenate([owner, at[has], np.repeat(at[~has], times)])
    places = np.concatenate([flat >> START & 63, place[has], np.repeat(place[~has], times)])
    found = np.concatenate([flat & ((1 << END) - 1), ids[known[has]], listed])
    # A stable sort keeps the bytes of a character in order.
    order = np.lexsort((places, owners))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(words)))]), pa.int32()), pa.array(found[order], pa.int32()))


def _viterbi_fold(n: Column, edges: Column, unknown: float) -> Column:
    """Boundaries of the path with the best total score; a character without a piece costs the unknown score."""
    least = -1e300
    single = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("s"), (i + 1).alias("e"), F.lit(unknown).alias("score")))
    have = F.transform(F.filter(edges, lambda e: e["e"] - e["s"] == 1), lambda e: e["s"])
    steps = F.concat(F.transform(edges, lambda e: F.struct(e["s"].alias("s"), e["e"].alias("e"), e["score"].alias("score"))), F.filter(single, lambda x: ~F.array_contains(have, x["s"])))
    ordered = F.array_sort(F.transform(steps, lambda x: F.struct(x["e"].alias("e"), x["s"].alias("s"), x["score"].alias("score"))))
    start = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.when(i == 0, F.lit(0.0)).otherwise(F.lit(least)).alias("best"), F.lit(0).alias("back")))

    def step(state: Column, x: Column) -> Column:
        total = F.get(state, x["s"])["best"] + x["score"]
        better = total > F.get(state, x["e"])["best"]
        return F.when(better, F.transform(state, lambda v, i: F.when(i == x["e"], F.struct(total.alias("best"), x["s"].alias("back"))).otherwise(v))).otherwise(state)

    back = lambda path: F.aggregate(
        F.sequence(F.lit(1), n),
        F.array(n),
        lambda b, _: F.when(F.get(b, F.lit(0)) == 0, b).otherwise(F.concat(F.array(F.get(path, F.get(b, F.lit(0)))["back"]), b)),
    )
    return _let(F.aggregate(ordered, start, step), back)


def _long_bounds(n: int, edges: list, bpe: bool, unknown: float) -> list[int]:
    """The folds' rule for a long word."""
    if not bpe:
        best, back, into = [0.0] + [-1e300] * n, [0] * (n + 1), {}
        for e in edges:
            into.setdefault(e["e"], []).append((e["s"], e["score"]))
        for end in range(1, n + 1):
            steps = sorted(into.get(end, []))
            for s, score in steps if any(s == end - 1 for s, _ in steps) else sorted([*steps, (end - 1, unknown)]):
                if best[s] + score > best[end]:
                    best[end], back[end] = best[s] + score, s
        bounds = [n]
        while bounds[-1]:
            bounds.append(back[bounds[-1]])
        return bounds[::-1]
    ranks = {(e["s"], e["e"]): e["rank"] for e in edges}
    nxt, prv = list(range(1, n + 2)), list(range(-1, n + 1))
    alive = [True] * (n + 1)
    heap = [(ranks[i, i + 2], i, i + 1, i + 2) for i in range(n - 1) if (i, i + 2) in ranks]
    heapq.heapify(heap)
    while heap:
        _, a, mid, b = heapq.heappop(heap)
        if not (alive[a] and alive[mid] and (b == n or alive[b]) and nxt[a] == mid and nxt[mid] == b):
            continue
        alive[mid] = False
        nxt[a], prv[b] = b, a
        for s, m, e in ((prv[a], a, b), (a, b, nxt[b] if b < n else -1)):
            if s >= 0 and 0 < e <= n and (s, e) in ranks:
                heapq.heappush(heap, (ranks[s, e], s, m, e))
    return [i for i in range(n + 1) if i in (0, n) or alive[i]]


def _lattice(distinct: DataFrame, table: DataFrame, most: int, shortest: int = 1) -> DataFrame:
    """The substrings of distinct(word, ...) that are pieces of ``shortest`` characters at least, with start s and end e; and each word's empty one.

    Both explosions and the broadcast join keep the partitions, so grouping by word moves nothing again.
    """
    n = F.length("word")
    own = distinct.columns
    starts = distinct.where(n > 0).select(*own, F.explode(F.sequence(F.lit(0), F.greatest(n - shortest, F.lit(0)))).alias("s"))
    ends = F.sequence(F.col("s") + shortest, F.least(F.col("s") + most, n))
    ends = F.when(n < shortest, F.array(F.lit(0))).when(F.col("s") == 0, F.concat(F.array(F.lit(0)), ends)).otherwise(ends)
    each = starts.select(*own, "s", F.explode(ends).alias("e"))
    return each.withColumn("piece", F.substring("word", F.col("s") + 1, F.col("e") - F.col("s"))).join(F.broadcast(table), "piece")


def encode_words(distinct: DataFrame, table: DataFrame, model: dict) -> DataFrame:
    """distinct(word, ...) with ids. table is the model's piece table, whose size the model file fixes."""
    most = max(len(p[0]) for p in model["pieces"])
    bpe = model["bpe"]
    unknown = min((p[2] for p in model["pieces"] if p[3] == NORMAL), default=0.0) - 10
    n = F.length("word")
    own = distinct.columns
    # Few enough words a partition to gather their edges in memory.
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() // PARTITION_WORDS))
    dealt = distinct.repartition(parts, "word")
    edge = F.struct("s", "e", "id", "rank", *([] if bpe else ["score"]))
    packed = sum(F.shiftleft(F.col(c).cast("long"), low) for c, low in (("rank", RANK), ("s", START), ("e", END))) + F.col("id")
    # Merges begin with pairs: what a character left alone becomes is looked up, not joined.
    shortest = 2 if bpe else 1
    grouped = lambda words, x: _lattice(words, table, most, shortest).groupBy(*own).agg(F.collect_list(F.when(F.col("id") >= 0, x)).alias("edges"))
    short, long = dealt.where(n <= FOLD_CHARS), dealt.where(n > FOLD_CHARS)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def long_bounds(w: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([_long_bounds(len(a), list(b), bpe, unknown) for a, b in zip(w, e, strict=True)])

    # A piece is the edge between two boundaries, or the bytes of a character that has none.
    bytes_at = next((p[1] for p in model["pieces"] if p[3] == BYTE), None)
    unk = next((p[1] for p in model["pieces"] if p[3] == UNKNOWN), 0)
    if bytes_at is None:
        spelled = lambda c: F.array(F.lit(unk))
    else:
        hexed = lambda c: F.hex(F.encode(c, "UTF-8"))
        spelled = lambda c: F.transform(F.sequence(F.lit(1), F.length(hexed(c)), F.lit(2)), lambda k: F.conv(F.substring(hexed(c), k, F.lit(2)), 16, 10).cast("int") + bytes_at)
    lone = sorted((ord(p[0]), p[1]) for p in model["pieces"] if p[3] == NORMAL and len(p[0]) == 1)
    single, single_ids = np.array([c for c, _ in lone], np.int64), np.array([k for _, k in lone], np.int64)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def merged(words: pa.Array, edges: pa.Array) -> pa.Array:
        return _merge_ids(words, edges, single, single_ids, bytes_at, unk)

    # As the edges of long words have no single characters either: the id of a character's own piece, or null.
    lone_id = lambda c: F.get(F.array(*(F.lit(k) for _, k in lone)), F.instr(F.lit("".join(chr(x) for x, _ in lone)), c) - 1)

    def ids(cuts: Column, find: Callable[[Column, Column], Column]) -> Column:
        def piece(start: Column, end: Column) -> Column:
            char = F.substring("word", start + 1, F.lit(1))
            found = F.when(end - start == 1, lone_id(char)).otherwise(find(start, end)) if bpe and lone else find(start, end)
            return _let(found, lambda k: F.when(k.isNotNull(), F.array(k)).otherwise(spelled(char)))

        return F.flatten(F.transform(F.slice(cuts, F.lit(1), F.size(cuts) - 1), lambda b, i: piece(b, F.get(cuts, i + 1))))

    find = lambda s, e: F.get(F.filter("edges", lambda x: (x["s"] == s) & (x["e"] == e)), F.lit(0))["id"]
    folded = lambda cuts: _let(cuts, lambda c: ids(c, find)).alias("ids")
    made = merged("word", "edges").alias("ids") if bpe else folded(_viterbi_fold(n, F.col("edges"), unknown))
    beyond = grouped(long, edge).withColumn("bounds", long_bounds("word", "edges"))
    return grouped(short, packed if bpe else edge).select(*own, made).unionByName(beyond.select(*own, folded(F.col("bounds"))))


def _separator(texts: pa.Array) -> str:
    """A code point that none of the texts holds; noncharacters first."""
    for code in [*range(0xFDD0, 0xFDF0), *range(0xE000, 0xF900)]:
        if not pc.any(pc.match_substring(texts, chr(code))).as_py():
            return chr(code)
    raise ValueError("every private code point stands in one batch")


class Cutter:
    """Cuts Arrow batches of texts into words.

    A text is first cut at each space that ends a run of other characters, as no word spans such a space. Each distinct part is cut
    once: parts of the usual shapes (letters, then marks, over one or two lines) by one Arrow pattern, others by the word pattern.
    """

    def __init__(self, pieces: list[tuple]) -> None:
        self.find = re.compile(word_pattern(pieces, PYTHON_CODE)).findall
        classes = word_classes(pieces, ARROW_CODE)
        letters, marks = classes if len(classes) == 2 else (None, None)
        line = lambda k: f"(?P<a{k}>{letters}+)(?P<b{k}>{marks}*)"
        # A line break is a word of its own unless a piece holds it beside other characters.
        broken = letters and not any("\n" in p[0] for p in pieces if len(p[0]) > 1)
        self.usual = letters and f"^{line(0)}" + (f"(?:(?P<n>\n){line(1)})?$" if broken else "$")

    def _parts(self, parts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        """Distinct words of the parts, each part's words' numbers, one after another, and where each part's begin."""
        if self.usual:
            shape = pc.extract_regex(parts, self.usual)
            usual = pc.is_valid(shape).to_numpy(zero_copy_only=False)
            fields = [pc.struct_field(shape, f.name).filter(pa.array(usual)) for f in shape.type]
        else:
            usual, fields = np.zeros(len(parts), bool), [pa.array([], pa.string())]
        if self.usual:
            fields[0] = pc.binary_join_element_wise(MARK, fields[0], "")
        lists = [self.find(MARK + t.replace(" ", MARK)) for t in parts.filter(pa.array(~usual)).to_pylist()]
        each = pa.concat_arrays([*fields, pa.array([w for x in lists for w in x], pa.string())]).dictionary_encode()
        words, code = each.dictionary, each.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(fields[0])
        blank = pc.index(words, "").as_py()
        shaped = code[: n * len(fields)].reshape(len(fields), n).T
        there = shaped != blank
        size = np.empty(len(parts), np.int64)
        size[usual], size[~usual] = there.sum(1), [len(x) for x in lists]
        starts = np.concatenate([[0], np.cumsum(size)])
        owner = np.repeat(usual, size)
        out = np.empty(starts[-1], np.int64)
        out[owner], out[~owner] = shaped[there], code[n * len(fields) :]
        return words, out, starts

    def __call__(self, texts: pa.Array) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words, parts' words (numbers, begins), each occurring part's number, and rows' offsets among those."""
        # A copy of its own: pyarrow 23's if_else misreads slices of large strings.
        texts = texts.cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
        texts = pc.if_else(pc.equal(texts, ""), pa.scalar(None, pa.large_string()), texts)
        mark = _separator(texts)
        # Where single spaces part other characters, each of them is such a space.
        odd = pc.fill_null(pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, f"{MARK} ")), pc.starts_with(texts, " ")), False)
        cut = pc.replace_substring(texts, " ", mark)
        if pc.any(odd).as_py():
            some = pc.if_else(odd, texts, pa.scalar(None, pa.large_string()))
            cut = pc.if_else(odd, pc.replace_substring_regex(some, f"([^ {MARK}]) ", rf"\1{mark}"), cut)
        parts, part, off = coded(pc.split_pattern(cut, mark))
        return *self._parts(parts), part, off


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about so much each; ends tell where rows end, from 0 on."""
    edges = [0, *(np.flatnonzero(np.diff(ends[1:] // most)) + 1).tolist(), len(ends) - 1]
    return ((a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b)


def _slices(rows: pa.Array, most: int = TEXT_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about so many bytes each; what a run took is given back before the next."""
    size = pc.fill_null(pc.binary_length(rows), 0).to_numpy(zero_copy_only=False)
    for a, b in _runs(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), most):
        yield a, b
        pa.default_memory_pool().release_unused()


def _counted(documents: DataFrame, model: dict) -> DataFrame:
    """(word, c): words and counts of batches of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(model["pieces"])
        for b in batches:
            for lo, hi in _slices(b.column(0)):
                words, word, starts, part, _ = cutter(b.column(0).slice(lo, hi - lo))
                times = np.repeat(np.bincount(part, minlength=len(starts) - 1), np.diff(starts))
                c = np.bincount(word, times, len(words)).astype(np.int64)
                seen = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(seen)), pa.array(c[seen])], ["word", "c"])

    return documents.select("text").mapInArrow(run, "word string, c long")


def dictionary(documents: DataFrame, model: dict) -> tuple[DataFrame, int, str]:
    """(word, c, ids) of every distinct word, the count from which on a word belongs to the HOT_WORDS, and where the table lies."""
    spark = documents.sparkSession
    words, path = scratch(spark, "words"), scratch(spark, "pieces")
    _counted(documents, model).groupBy("word").agg(F.sum("c").alias("c")).write.parquet(words)
    release(spark, LISTENERS)
    # Words' edges are gathered in memory, HASHED_WORDS words of a partition at most; beyond that Spark sorts them. The setting
    # holds in a session of its own.
    own = spark.newSession()
    for name, value in ((HASH_LIMIT, str(HASHED_WORDS)), *((k, spark.conf.get(k)) for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"))):
        own.conf.set(name, value)
    encoded = encode_words(own.read.schema("word string, c long").parquet(words), piece_table(own, model), model)
    encoded.write.parquet(path)
    encoded = spark.read.schema(encoded.schema).parquet(path)
    forget(spark, words)
    release(spark, LISTENERS)
    # How many words have each count, from the most frequent down.
    spread = encoded.groupBy("c").agg(F.count("*").alias("k")).orderBy(F.desc("c")).limit(HOT_WORDS).toPandas()
    fits = np.flatnonzero(np.cumsum(spread["k"].to_numpy()) <= HOT_WORDS)
    return encoded, int(spread["c"].iloc[fits[-1]]) if len(fits) else 2**62, path


class Names:
    """Words and their numbers. They are found by hash, and compared; each process sorts the hashes once, so a batch doesn't pay for them."""

    def __init__(self, words: pa.StringArray) -> None:
        self.words = words

    def __reduce__(self) -> tuple:
        return Names, (self.words,)

    @staticmethod
    def _hashes(words: pa.StringArray) -> np.ndarray:
        some = (words.slice(k, HASHED).to_numpy(zero_copy_only=False) for k in range(0, len(words), HASHED))
        return np.concatenate([np.empty(0, np.uint64), *(pd.util.hash_array(w, categorize=False) for w in some)])

    @cached_property
    def _index(self) -> tuple[np.ndarray, np.ndarray]:
        found = self._hashes(self.words)
        order = np.argsort(found, kind="stable").astype(np.int32)
        return found[order], order

    def find(self, words: pa.StringArray) -> np.ndarray:
        """Each word's number, or -1."""
        hashes, order = self._index
        if not len(order):
            return np.full(len(words), -1)
        own = self._hashes(words)
        at = np.minimum(np.searchsorted(hashes, own), len(order) - 1)
        out = np.full(len(words), -1)
        left = np.flatnonzero(hashes[at] == own)
        while len(left):
            same = pc.equal(self.words.take(pa.array(order[at[left]])), words.take(pa.array(left))).to_numpy(zero_copy_only=False)
            out[left[same]] = order[at[left[same]]]
            # Another word of the same hash stands next to it.
            left = left[~same & (at[left] + 1 < len(order))]
            at[left] += 1
            left = left[hashes[at[left]] == own[left]]
        return out


def _frequent(encoded: DataFrame, least: int, id_type: str) -> tuple[pa.StringArray, tuple[np.ndarray, np.ndarray]]:
    """The frequent words, most frequent first, and their pieces with where each word's begin; at most HOT_WORDS words."""
    t = encoded.where(F.col("c") >= least).select("word", "ids", "c").toArrow().combine_chunks()
    t = t.take(pa.array(np.argsort(-t["c"].to_numpy(), kind="stable"))).combine_chunks()
    words, ids = (pa.chunked_array(t[c].chunks, t[c].type).combine_chunks() for c in ("word", "ids"))
    size = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
    return words.cast(pa.string()), (pc.list_flatten(ids).to_numpy(zero_copy_only=False).astype("int16" if id_type == "short" else "int32"), np.concatenate([[0], np.cumsum(size)]).astype(np.int32))


def _packed(numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of numbers as bytes, seven bits each, the low ones first; all but a number's last have the high bit. ends tell where rows end, from 0 on."""
    size = 1 + sum((numbers >= 1 << bits).astype(np.int64) for bits in (7, 14, 21, 28))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.uint8)
    for k in range(size.max(initial=0)):
        has = size > k
        out[at[:-1][has] + k] = (numbers[has] >> 7 * k & 127) | np.where(size[has] > k + 1, 128, 0)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at[ends].astype(np.int32)), pa.py_buffer(out)])


def _unpacked(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of packed rows, and where each row's begin (with the end last)."""
    size = pc.binary_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
    b = np.frombuffer(b"".join(rows.to_pylist()), np.uint8)
    last = np.flatnonzero(b < 128)
    at = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    numbers = np.zeros(len(last), np.int64)
    for k in range((last - at).max(initial=-1) + 1):
        has = last - at >= k
        numbers[has] |= (b[at[has] + k] & 127).astype(np.int64) << 7 * k
    return numbers, np.searchsorted(last, np.concatenate([[0], np.cumsum(size)]))


def _gather(values: np.ndarray, off: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered by index, one after another, and where each begins (with the end last)."""
    size = np.diff(off)[index]
    ends = np.concatenate([[0], np.cumsum(size)])
    return values[np.arange(ends[-1]) + np.repeat(off[:-1][index] - ends[:-1], size)], ends


def _row_key() -> list[Column]:
    """What tells rows of documents apart, but for rows with equal texts: these have the same words."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), F.xxhash64("text")]


def _rare(word: np.ndarray, starts: np.ndarray, part: np.ndarray, off: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The occurrences of rare words: row, word and place among the row's rare words by first occurrence; and which occurrences are first."""
    # Parts with a rare word are few.
    odd = np.add.reduceat(np.append(rare[word], False), starts[:-1]) > 0 if len(starts) > 1 else np.zeros(0, bool)
    at = np.flatnonzero(odd[part])
    inside, begins = _gather(word, starts, part[at])
    row = np.repeat(np.searchsorted(off, at, "right") - 1, np.diff(begins))
    keep = rare[inside]
    row, inside = row[keep], inside[keep]
    _, first, same = np.unique(row * max(len(rare), 1) + inside, return_index=True, return_inverse=True)
    # Rows stand one after another, so a row's first occurrences have numbers in a run.
    number = np.empty(len(first), np.int64)
    number[np.argsort(first)] = np.arange(len(first))
    before = np.searchsorted(row[np.sort(first)], row, "left")
    return row, inside, number[same.reshape(-1)] - before, np.sort(first)


def _rare_words(documents: DataFrame, model: dict, sent) -> DataFrame:
    """(did, fp, k, word): each row's distinct words that are not among the frequent ones, by first occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, hot = Cutter(model["pieces"]), sent.value
        for b in batches:
            for lo, hi in _slices(b.column(2)):
                words, word, starts, part, off = cutter(b.column(2).slice(lo, hi - lo))
                row, inside, k, first = _rare(word, starts, part, off, hot.find(words) < 0)
                rows = pa.array(lo + row[first])
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(k[first], pa.int32()), words.take(pa.array(inside[first]))], ["did", "fp", "k", "word"])

    return documents.select(*_row_key(), "text").mapInArrow(run, "did long, fp long, k int, word string")


def encode_ids(documents: DataFrame, model: dict) -> DataFrame:
    """documents with the column ids: the piece ids of each whole text; a column ids is replaced.

    What meets the rare words' pieces is not the text but its words' numbers among the frequent ones, the most frequent having the shortest
    numbers, with a gap for each rare word, and these words' numbers; so a text moves only if the caller asks for it. The rare words' pieces
    are gathered by row and written before, so that the files of that join are gone when documents move, and what then meets the
    documents is one row each.
    """
    spark = documents.sparkSession
    small_batches(spark)
    encoded, least, path = dictionary(documents, model)
    id_type = "short" if len(model["pieces"]) < 1 << 15 else "int"
    hot_words, hot_pieces = _frequent(encoded, least, id_type)
    names, sent = spark.sparkContext.broadcast(Names(hot_words)), spark.sparkContext.broadcast(hot_pieces)
    own = [c for c in documents.columns if c != "ids"]
    spelled = encoded.where(F.col("c") < least).select("word", F.transform("ids", lambda x: x.cast(id_type)).alias("ids"))
    rare = _rare_words(documents, model, names).join(spelled, "word").select("did", "fp", "k", "ids").repartition("did", "fp")
    # As a set: rows that repeat doc_id and text give the same words. Their numbers k run from 0 on, so the order tells them.
    rare = rare.groupBy("did", "fp").agg(F.array_sort(F.collect_set(F.struct("k", "ids"))).alias("rare"))
    rare = cut(rare.select("did", "fp", F.struct(F.transform("rare", lambda x: F.size(x["ids"])).alias("sizes"), F.flatten(F.transform("rare", lambda x: x["ids"])).alias("ids")).alias("rare")), "rare-pieces")
    forget(spark, path)
    release(spark, LISTENERS)

    @F.arrow_udf("struct<words: binary, ks: binary>")
    def gapped(texts: pa.Array) -> pa.Array:
        cutter, hot = Cutter(model["pieces"]), names.value
        made = [pa.array([], pa.struct([("words", pa.binary()), ("ks", pa.binary())]))]
        for lo, hi in _slices(texts):
            words, word, starts, part, off = cutter(texts.slice(lo, hi - lo))
            at = hot.find(words)
            row, _, k, _ = _rare(word, starts, part, off, at < 0)
            # Words' numbers make parts' numbers, and these the rows'.
            number = np.where(at < 0, GAP, at + 1).astype(np.int32)[word]
            packed = []
            for a, b in _runs(off, WORDS):
                numbers, ends = _gather(number, starts, part[off[a] : off[b]])
                packed.append(_packed(numbers, ends[off[a : b + 1] - off[a]]))
            made.append(pa.StructArray.from_arrays([pa.concat_arrays(packed), _packed(k, np.searchsorted(row, np.arange(len(off))))], ["words", "ks"]))
        return pa.concat_arrays(made)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def filled(rows: pa.Array, extra: pa.Array) -> pa.Array:
        made, (hot, hot_begins) = [pa.array([], pa.list_(pa.int32()))], sent.value
        for lo, hi in _slices(pc.struct_field(rows, "words"), 2 * WORDS):
            (numbers, begins), (ks, k_begins) = (_unpacked(pc.struct_field(rows, name).slice(lo, hi - lo)) for name in ("words", "ks"))
            # The rows' rare words one after another; the gaps take theirs in turn.
            sizes, cold = (pc.struct_field(extra.slice(lo, hi - lo), name) for name in ("sizes", "ids"))
            n = pc.fill_null(pc.list_value_length(sizes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            each = np.cumsum(pc.list_flatten(sizes).to_numpy(zero_copy_only=False), dtype=np.int64)
            index = numbers - 1
            index[numbers == GAP] = len(hot_begins) - 1 + np.repeat(np.cumsum(n) - n, np.diff(k_begins)) + ks
            pieces = np.concatenate([hot, pc.list_flatten(cold).to_numpy(zero_copy_only=False).astype(hot.dtype)])
            ids, ends = _gather(pieces, np.concatenate([hot_begins, hot_begins[-1] + each]), index)
            made.append(pa.ListArray.from_arrays(pa.array(ends[begins], pa.int32()), pa.array(ids.astype(np.int32), pa.int32())))
        return pa.concat_arrays(made)

    # The caller's columns go by numbers on the way, so none can clash with those added here.
    did, fp = _row_key()
    text = F.col(f"`{own[[c.lower() for c in own].index('text')]}`")
    docs = documents.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(own)), did.alias("did"), fp.alias("fp"), gapped(text).alias("gapped"))
    joined = docs.join(rare, ["did", "fp"], "left")
    return joined.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(own)), filled("gapped", "rare").alias("ids"))


def decode(encoded: DataFrame, model: dict, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with the text of its ids; a null list stays null."""
    spell = [bytes([int(p[0][3:5], 16)]) if p[3] == BYTE else p[0].replace(MARK, " ").encode() if p[3] == NORMAL else " \u2047 ".encode() if p[3] == UNKNOWN else b"" for p in model["pieces"]]
    sent = encoded.sparkSession.sparkContext.broadcast(spell)

    @F.arrow_udf(T.StringType())
    def text(lists: pa.Array) -> pa.Array:
        table, made = pa.array(sent.value, pa.large_binary()), [pa.array([], pa.large_string())]
        step = max(1, len(lists) * TEXT_BYTES // max(8 * len(pc.list_flatten(lists)), 1))
        for k in range(0, len(lists), step):
            some = lists.slice(k, step)
            bytes_ = table.take(pc.list_flatten(some))
            size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False))])
            ends = np.frombuffer(bytes_.buffers()[1], np.int64)[bytes_.offset :][size] if len(bytes_) else np.zeros(len(size), np.int64)
            rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(ends.astype(np.int64)), bytes_.buffers()[2] if len(bytes_) else pa.py_buffer(b"")])
            rows = pc.if_else(pc.is_valid(some), rows, pa.scalar(None, pa.large_binary()))
            try:
                rows = rows.cast(pa.large_string())
            except pa.ArrowInvalid:  # ids that no text has
                rows = pa.array([None if x is None else x.decode("utf-8", "replace") for x in rows.to_pylist()], pa.large_string())
            made.append(pc.if_else(pc.starts_with(rows, " "), pc.utf8_slice_codeunits(rows, 1), rows))
        return pa.concat_arrays(made).cast(pa.string())

    return encoded.withColumn(into, text(ids))

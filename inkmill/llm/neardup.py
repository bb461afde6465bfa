"""Near-duplicates: a multi-index Hamming join over b-bit MinHash signatures, confirmed on full shingle sets.

A document's set holds its distinct five-word shingles (fewer words: the whole sequence as one). Documents with
equal sets form a class, and only one member of a class goes on. A signature is 48 symbols of 14 bits, each cut
from the minimum of one hash of the set; two sets of similarity J differ in about 48 * (1 - J) symbols. The signature
is split into 12 chunks of 4 symbols. By the pigeonhole principle, two signatures that differ in at most 23
symbols have a chunk with at most one difference, so indexing each chunk with each one of its symbols left out
finds every such pair. At similarity 0.75 more than 23 differences have a chance of about 1 in 10,000.

Pairs of a bucket are not all formed. First every document is compared with the most alike one among those that lead its
buckets and whose signatures are within the distance, and components are formed from the confirmed links. A bucket whose
members are then in one component needs nothing more. The members of the others go through an exact prefix
join: shingles ordered by rarity, the lists of those that a partner must share, again one partner at a time, led by another member each turn, then,
in lists still open, all pairs across components that are within the signature distance, each in one of its lists. No
pair is given up: a list costs more only while texts in it stay unlinked.

A key that many nodes share, and a node that many pairs share, are split: grouped minima are written before they are joined,
so that Spark deals a large key's rows anew, and a node's pairs meet its set in blocks of PAIRS.

Nulls and odd input: null or empty text has an empty set and links with nothing. Texts are linked, not ids: rows that repeat a
doc_id are in one component only if their texts are, and each gets the smallest doc_id of its own component. A row without
a doc_id links texts as any other; it is never a component's id, and a component of such rows only has none. Repeated rows stay
repeated. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if, columns, cut, fitted, release
from .graph import components
from .subwords import in_slices

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS, CHUNK = 48, 4
#: A chunk's symbols share a long, 15 bits apart, so that lanes can be compared without a carry between them.
BITS, LANE = 14, 15
LOW, HIGH = (sum(((1 << BITS) - 1 if low else 1 << BITS) << (LANE * k) for k in range(CHUNK)) for low in (True, False))
#: Two signatures this far apart or less share a bucket.
MOST_DIFFERENCES = 2 * (SYMBOLS // CHUNK) - 1
BROADCAST_NODES = 200_000
#: As many rows as need all partitions: for tables that have not been counted.
MANY = 1 << 40
#: Rows that a Python worker works on at a time.
ROWS = 1000
#: Pairs of a node that meet its set at once.
PAIRS = 512
#: Turns of one partner a node in the lists of the prefix join, at most, before pairs across components are formed; they end when fewer than one
#: node in FEW has found a link.
ROUNDS, FEW = 8, 50

_rng = np.random.default_rng(20240501)
_WORD_MULTIPLIERS = _rng.integers(1, 2**63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_MULTIPLY = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _shingle_sets(words: pa.ListArray, size: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes from its word hashes."""
    off = words.offsets.to_numpy()
    h, off = words.values[off[0] : off[-1]].to_numpy(zero_copy_only=False).view(np.uint64), off - off[0]
    c = _WORD_MULTIPLIERS
    rolled = _mix(sum(h[i : len(h) - size + 1 + i] * c[i] for i in range(size))) if len(h) >= size else h[:0]
    sets = []
    for a, b in zip(off[:-1], off[1:], strict=True):
        if b - a >= size:
            sets.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            short = h[a:b]
            sets.append(_mix((short * c[: b - a]).sum(keepdims=True) + np.array([b - a], np.uint64) * c[5]))
        else:
            sets.append(h[:0])
    return sets


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of SYMBOLS symbols; sets must not be empty."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    flat = np.concatenate(sets)
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        out[:, k] = _mix(np.minimum.reduceat((flat ^ _XOR[k]) * _MULTIPLY[k], starts)) >> np.uint64(64 - BITS)
    return out


def _packed(symbols: np.ndarray) -> pa.ListArray:
    """Signatures as lists of SYMBOLS / CHUNK longs."""
    s = symbols.astype(np.int64).reshape(-1, CHUNK)
    longs = sum(s[:, k] << (LANE * k) for k in range(CHUNK))
    width = SYMBOLS // CHUNK
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(longs) + 1, width), pa.int32()), pa.array(longs))


def _unpacked(sigs: pa.ListArray) -> np.ndarray:
    longs = sigs.flatten().to_numpy(zero_copy_only=False)
    return np.stack([longs >> (LANE * k) & ((1 << BITS) - 1) for k in range(CHUNK)], 1).reshape(-1, SYMBOLS)


def _differences(a: Column, b: Column) -> Column:
    """In how many symbols two signatures differ: a lane that differs fills its top bit."""
    total = F.lit(0)
    for k in range(SYMBOLS // CHUNK):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        total = total + F.bit_count((x + F.lit(LOW)).bitwiseAND(F.lit(HIGH)))
    return total


def _hashed_words(documents: DataFrame) -> DataFrame:
    w = F.coalesce(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    return documents.select(*(c for c in documents.columns if c != "text"), F.transform(w, lambda x: F.xxhash64(x)).alias("w"))


def _keyed_texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("fp"), "text")


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def sketches(documents: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, fp (hash of the text), n (set size), digest and sig (both null for an empty set) of documents(doc_id, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, ROWS):
            sets = _shingle_sets(b.column(2), shingle)
            full = [s for s in sets if len(s)]
            packed = _packed(_signatures(full)) if full else pa.array([], pa.list_(pa.int64()))
            row = np.cumsum([0, *(len(s) > 0 for s in sets[:-1])])
            sig = packed.take(pa.array([int(r) if len(s) else None for r, s in zip(row, sets, strict=True)], pa.int64()))
            digest = pa.array(map(_digest, sets), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), digest, sig], ["doc_id", "fp", "n", "digest", "sig"])

    return _hashed_words(_keyed_texts(documents)).mapInArrow(make, "doc_id long, fp long, n long, digest binary, sig array<long>")


def _sets_of(documents: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node and its full set, of nodes(node, digest, doc_id, fp), from the row of documents that doc_id and fp name."""
    nodes = cut(nodes.select("node", "digest", F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")), "nodes")
    n = nodes.count()
    docs = _keyed_texts(documents).join(broadcast_if(nodes, n, BROADCAST_NODES), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, ROWS):
            sets = _shingle_sets(b.column(2), shingle)
            own = [d == _digest(s) for d, s in zip(b.column(1).to_pylist(), sets, strict=True)]
            sets = [s for s, ok in zip(sets, own, strict=True) if ok]
            off = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(own, pa.bool_())), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat))], ["node", "set"])

    sets = cut(_hashed_words(docs.select("node", "digest", "text")).mapInArrow(make, "node long, set array<long>"), "sets")
    # Rows that repeat both doc_id and text give their node's set again.
    return sets if sets.count() == n else cut(sets.dropDuplicates(["node"]), "sets")


def _keys(reps: DataFrame) -> DataFrame:
    """(key, node): each chunk of a signature with each one of its symbols left out."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, ROWS):
            sig = _unpacked(b.column(1)).astype(np.uint64)
            keys = []
            for c in range(0, SYMBOLS, CHUNK):
                for out in range(CHUNK):
                    key = np.full(len(sig), c + out, np.uint64)
                    for k in range(c, c + CHUNK):
                        if k != c + out:
                            key = key << np.uint64(BITS) | sig[:, k]
                    keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(b.column(0).to_numpy(), SYMBOLS))], ["key", "node"])

    return reps.select("node", "sig").mapInArrow(make, "key long, node long")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity. A node's set meets its pairs in blocks of PAIRS."""
    blocks = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("blocks")), "blocks")
    hubs = blocks.where("blocks > 1")
    n_hubs = hubs.count()
    part = F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1))).cast("int")
    left = pairs.join(broadcast_if(hubs, n_hubs, BROADCAST_NODES), "a", "left").select("a", "b", part.alias("part"))
    left = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("b_set")), "b")
    right = sets.withColumnRenamed("node", "a").join(blocks, "a").select("a", F.col("set").alias("a_set"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    common = F.size(F.array_intersect("a_set", "b_set"))
    return left.join(right, ["a", "part"]).where(100 * common >= percent * (F.size("a_set") + F.size("b_set") - common)).select("a", "b")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _open(members: DataFrame, labels: DataFrame, rows: int = MANY) -> DataFrame:
    """The members(key, node, ...) of the keys whose members are not in one component."""
    found = _labelled(members, labels).groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return members.join(cut(fitted(found.where("lo <> hi").select("key"), rows), "open"), "key")


def _partners(members: DataFrame, labels: DataFrame | None = None, turn: int = 0, rows: int = MANY) -> DataFrame:
    """Each node with one partner of another component, the most alike among those that lead its keys.

    The smallest member leads a key at first, later the first in an order of its own each turn, so that a leader that few members are
    linked with is not asked again.
    """
    m = _labelled(members, labels) if labels else members.withColumn("component", F.col("node"))
    order = F.xxhash64("node", F.lit(turn)) if turn else F.col("node")
    lead = m.groupBy("key").agg(F.min(F.struct(order.alias("order"), "node", "component", "sig")).alias("x"))
    lead = cut(fitted(lead.select(F.col("key").alias("k"), F.col("x.node").alias("lead"), F.col("x.component").alias("c"), F.col("x.sig").alias("lead_sig")), rows), "first")
    met = m.join(lead, (m["key"] == lead["k"]) & (m["component"] != lead["c"]) & (_differences(m["sig"], lead["lead_sig"]) <= MOST_DIFFERENCES))
    best = met.groupBy("node").agg(F.min(F.struct(_differences(F.col("sig"), F.col("lead_sig")).alias("d"), "lead")).alias("x"))
    return best.select(F.col("x.lead").alias("a"), F.col("node").alias("b"))


def _across(lists: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Alike pairs across components of lists(key, node, n, first, sig, prefix), each at the first list of both."""
    m = _labelled(lists, labels)
    one, two = (m.select("key", *(F.col(c).alias(f"{x}_{c}") for c in ("node", "component", "n", "first", "sig", "prefix"))) for x in "ab")
    # What a set holds from its first shared shingle on bounds the overlap.
    left = lambda x: F.col(f"{x}_n") - F.col(f"{x}_first") - F.array_position(f"{x}_prefix", one["key"]) + 1
    fits = (
        (one["key"] == two["key"])
        & (F.col("a_node") < F.col("b_node"))
        & (F.col("a_component") != F.col("b_component"))
        & (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
        & (_differences(F.col("a_sig"), F.col("b_sig")) <= MOST_DIFFERENCES)
        & (F.get(F.array_intersect("a_prefix", "b_prefix"), F.lit(0)) == one["key"])
        & (F.least(left("a"), left("b")) * (100 + percent) >= percent * (F.col("a_n") + F.col("b_n")))
    )
    return one.join(two, fits).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, first, prefix): the rarest shingles of a set, one of which any partner of that similarity must share.

    first counts the shingles that no other set holds; they take the first places of the order, and need no list.
    """
    each = sets.select("node", F.size("set").alias("n"), F.explode("set").alias("key"))
    rarity = each.groupBy("key").agg(F.count("*").alias("df"))
    ranked = each.join(rarity.where("df > 1"), "key").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("shared"))
    first = F.col("n") - F.size("shared")
    keep = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - first).cast("int")
    return ranked.where(keep > 0).select("node", "n", first.alias("first"), F.transform(F.slice("shared", 1, keep), lambda x: x["key"]).alias("prefix"))


def _components(documents: DataFrame, percent: int, shingle: int) -> DataFrame:
    """doc_id, fp, n, digest and component_id of every row, and component, which also tells components without a doc_id apart."""
    rows = cut(sketches(documents, shingle), "sketches")
    # Nodes are numbered as they are written, so no two classes share one, whatever their doc_ids.
    classes = rows.where("digest IS NOT NULL").groupBy("digest", "sig").agg(F.min(F.struct("doc_id", "fp")).alias("x"), F.min("doc_id").alias("low_id"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "sig", "x.doc_id", "x.fp", "low_id"), "classes")
    reps = classes.select("node", "sig")
    keys = _keys(reps)
    shared = cut(keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key"), "shared")
    members = cut(keys.join(shared, "key").join(reps, "node").select("key", "node", "sig"), "buckets")
    # Texts are read again once, those of the nodes that share a bucket.
    sets = _sets_of(documents, classes.join(members.select("node").distinct(), "node", "left_semi"), shingle)
    confirm = lambda pairs: cut(_confirm(cut(pairs, "pairs"), sets, percent), "links")

    links = confirm(_partners(members))
    labels = cut(components(links), "labels")
    crowd = _open(members, labels).select("node").distinct()
    release(documents.sparkSession)
    prefixes = cut(_prefixes(sets.join(crowd, "node", "left_semi"), percent), "prefixes")
    lists = cut(prefixes.select("node", F.explode("prefix").alias("key")).join(reps, "node").select("key", "node", "sig"), "lists")
    n_lists, n_nodes = lists.count(), prefixes.count()
    for turn in range(1, ROUNDS + 1):
        open_ = cut(fitted(_open(lists, labels, n_lists), n_lists), "open_lists")
        n_lists = open_.count()
        found = confirm(fitted(_partners(open_, labels, turn, n_lists), n_nodes))
        n_found = found.count()
        if n_found:
            links = links.unionByName(found)
            labels = cut(components(links), "labels")
        release(documents.sparkSession)
        if FEW * n_found < open_.select("node").distinct().count():
            break
    rest = _open(lists, labels).join(prefixes, "node")
    links = links.unionByName(confirm(_across(rest, labels, percent)))
    labels = cut(components(links), "labels")

    per_class = cut(_labelled(classes.select("node", "digest", "low_id"), labels), "classes")
    ids = per_class.groupBy("component").agg(F.min("low_id").alias("component_id"))
    per_class = cut(per_class.join(ids, "component").select("digest", "component", "component_id"), "classes")
    return rows.select("doc_id", "fp", "n", "digest").join(per_class, "digest", "left")


def near_duplicates(documents: DataFrame, percent: int = 75, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of documents(doc_id, text)."""
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    found = _components(documents, percent, shingle)
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicate(documents: DataFrame, percent: int = 75, shingle: int = 5) -> DataFrame:
    """One row of each group of near-duplicates, with its own columns.

    That of the smallest doc_id stays (null last), then that whose text has the smallest hash; of rows that repeat both, one. Rows
    without words are in no group and all stay.
    """
    found = cut(_components(documents, percent, shingle), "decisions")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    best = cut(found.where("component IS NOT NULL").groupBy("component").agg(F.min(row).alias("x")).select("component", F.col("x.doc_id").alias("_id"), F.col("x.fp").alias("_fp")), "best")
    each = found.where("component IS NOT NULL").join(best, "component").select("doc_id", "fp", (F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp"))).alias("stays"))
    named = each.groupBy("doc_id", "fp", "stays").agg(F.count("*").alias("n"))
    named = cut(named.where("NOT stays OR n > 1").select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"), F.col("stays").alias("_stays")), "named")
    of = lambda side: F.col("_doc.doc_id").cast("long").eqNullSafe(side["_id"]) & (F.col("_hash") == side["_fp"])
    docs = documents.select(F.struct(*columns(documents.columns)).alias("_doc"), F.xxhash64("text").alias("_hash"))
    left = docs.join(broadcast_if(named, named.count(), BROADCAST_NODES), of(named), "left_anti").select("_doc.*")
    many = named.where("_stays")
    n_many = many.count()
    if not n_many:
        return left
    again = docs.join(broadcast_if(many, n_many, BROADCAST_NODES), of(many)).groupBy("_id", "_fp").agg(F.min_by("_doc", F.xxhash64("_doc")).alias("_doc"))
    return left.unionByName(again.select("_doc.*"))

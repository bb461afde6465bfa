"""Near-duplicates by SimHash: fingerprints covered by anchor points, compared per anchor.

A fingerprint has 64 bits; a bit is 1 if it is set in over half the hashes of a text's word shingles. Two fingerprints that
differ in at most ``bits`` bits are linked, and nothing else is.

Anchors are words of a code of three parts: a word of the binary Golay code of length 23 over bits 0 to 22, another over bits 23 to 45, and any
PLAIN bits over those that follow. The Golay code is perfect: each word of 23 bits is within RADIUS = 3 of exactly one code word; plain bits have
radius 0. So every fingerprint has one home among the 2^27 anchors. If x has its home at an anchor and y differs from x in d bits, y
is in each part as near to the anchor as the radius and the bits that differ there. So y goes to every anchor within the radius plus
the threshold (part by part, the parts' excess over the radius together at most the threshold), and meets there each fingerprint whose home it
is: no pair within the threshold is missed, whatever its bits. With three bits a fingerprint goes to about 560 anchors; those that are
nobody's home are left out before anything moves, by one bit an anchor, 16 MB however large the input.

Only different fingerprints are compared. An anchor's rows are cut into a grid of blocks of at most BLOCK homes and BLOCK visitors, so a
crowded one is dealt to many tasks. A block is compared whole, but gives no pairs: each of its fingerprints is tied to the first
one that links reach within the block, so a block gives no more rows than it has. Components of those ties are the components of the links.

Nulls and odd input: null or empty text, or text of separators only, has fingerprint 0, which is linked like any other. A text of fewer words than
a shingle is one shingle. Rows that repeat a doc_id are judged by their texts; a row without a doc_id links as any other and is
never a component's id, and a component of such rows only has none. Repeated rows stay repeated. Very long texts cost in proportion. Extra
columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if, cut
from .graph import components
from .subwords import in_slices

WORD = r"[^\x20\x09-\x0D]+"
#: Length, data bits, covering radius and generator polynomial of the binary Golay code (fixed values).
LENGTH, DATA, RADIUS, GENERATOR = 23, 12, 3, 0b110001110101
CHECKS = LENGTH - DATA
#: Bits behind the two code words that are part of an anchor as they are.
PLAIN = 3
#: Homes, and visitors, that a block of an anchor holds at most.
BLOCK = 1024
#: Fingerprints that a Python worker spreads, or texts whose hashes it counts, at a time.
ROWS, TEXTS = 4096, 1000
#: Pairs that are compared at once.
PAIRS = 2_000_000
BROADCAST_HOT = 200_000


def _remainder(word: int) -> int:
    for k in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> k & 1:
            word ^= GENERATOR << (k - CHECKS)
    return word


def _majority(hashes: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of hashes that begin at starts and are n long, none of them empty."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(64):
        ones = np.add.reduceat((hashes >> np.uint64(k) & np.uint64(1)).astype(np.int64), starts)
        out |= (2 * ones > n).astype(np.uint64) << np.uint64(k)
    return out


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a long, of every row of documents(doc_id, text)."""
    w = F.col("w")
    each = F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(w, i + k) for k in range(shingle)))))
    h = F.when(F.size(w) >= shingle, each).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<long>"))
    found = F.coalesce(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    hashed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("w")).select("doc_id", h.alias("h"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, TEXTS):
            off = b.column(1).offsets.to_numpy()
            flat, off = b.column(1).values[off[0] : off[-1]].to_numpy(zero_copy_only=False).view(np.uint64), off - off[0]
            n, fp = np.diff(off), np.zeros(b.num_rows, np.uint64)
            if len(flat):
                fp[n > 0] = _majority(flat, off[:-1][n > 0], n[n > 0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return hashed.mapInArrow(make, "doc_id long, fp long")


class Cover:
    """The anchors around fingerprints, for a threshold of ``bits`` bits."""

    def __init__(self, bits: int):
        self.bits = bits
        masks, weights = [], []
        for k in range(RADIUS + bits + 1):
            masks += [sum(1 << i for i in c) for c in combinations(range(LENGTH), k)]
            weights += [k] * (len(masks) - len(weights))
        masks, excess = np.array(masks, np.int64), np.maximum(np.array(weights) - RADIUS, 0)
        self.bytes = [np.array([_remainder(x << s & (1 << LENGTH) - 1) for x in range(256)], np.int64) for s in (0, 8, 16)]
        # Words of the same remainder differ by a code word, so the changes that lead to a code word are those of that remainder.
        key = self.remainders(masks) * (bits + 1) + excess
        order = np.argsort(key, kind="stable")
        self.changes, self.at = masks[order], np.searchsorted(key[order], np.arange((1 << CHECKS) * (bits + 1) + 1))

    def remainders(self, words: np.ndarray) -> np.ndarray:
        return self.bytes[0][words & 255] ^ self.bytes[1][words >> 8 & 255] ^ self.bytes[2][words >> 16]

    def halves(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << LENGTH) - 1)
        return (fp & mask).astype(np.int64), (fp >> np.uint64(LENGTH) & mask).astype(np.int64)

    def near(self, words: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(which word, data bits of a code word): the code words whose excess over the radius is least to most."""
        key = self.remainders(words) * (self.bits + 1)
        which, at = ragged(self.at[key + least], self.at[key + most + 1])
        return which, (words[which] ^ self.changes[at]) >> CHECKS

    def homes(self, fp: np.ndarray) -> np.ndarray:
        one, two = (self.near(x, 0, 0)[1] for x in self.halves(fp))
        return (one << DATA | two) << PLAIN | self.plain(fp)

    def plain(self, fp: np.ndarray) -> np.ndarray:
        return (fp >> np.uint64(2 * LENGTH)).astype(np.int64) & ((1 << PLAIN) - 1)

    def visits(self, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which fingerprint, anchor): all anchors within the radius plus the threshold, part by part."""
        (one, two), plain = self.halves(fp), self.plain(fp)
        for used in range(self.bits + 1):
            which, a = self.near(one, used, used)
            for more in range(self.bits - used + 1):
                again, b = self.near(two[which], more, more)
                both, own = (a[again] << DATA | b) << PLAIN, which[again]
                for flips in range(1 << PLAIN):
                    if flips.bit_count() <= self.bits - used - more:
                        yield own, both | (plain[own] ^ flips)


def ragged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, position) of every position of the ranges."""
    n = ends - starts
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n - starts, n)


def _occupied(homes: DataFrame) -> np.ndarray:
    """A bit for each anchor that is some fingerprint's home: 2^27 bits, however many fingerprints there are."""
    number = F.col("anchor") + 1
    rows = homes.groupBy(F.bitmap_bucket_number(number).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("x")).collect()
    out = np.zeros(1 << (2 * DATA + PLAIN - 3), np.uint8)
    for r in rows:
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["x"], np.uint8)[: len(out)]
    return out


def _replicas(spark: SparkSession, classes: DataFrame, bits: int) -> DataFrame:
    """(anchor, fp, home): each fingerprint at every anchor around it that is some fingerprint's home."""

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = Cover(0)
        for b in in_slices(batches, ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(cover.homes(b.column(0).to_numpy().view(np.uint64)))], ["anchor"])

    sent = spark.sparkContext.broadcast(_occupied(classes.select("fp").mapInArrow(at_home, "anchor long")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover, occupied = Cover(bits), sent.value
        for b in in_slices(batches, ROWS):
            fp = b.column(0).to_numpy().view(np.uint64)
            home = cover.homes(fp)
            for which, anchor in cover.visits(fp):
                some = occupied[anchor >> 3] >> (anchor & 7).astype(np.uint8) & 1 > 0
                which, anchor = which[some], anchor[some]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[which].view(np.int64)), pa.array(home[which] == anchor)], ["anchor", "fp", "home"])

    return classes.select("fp").mapInArrow(spread, "anchor long, fp long, home boolean")


def _ties(fp: np.ndarray, group: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): each fingerprint that links tie to others of its group, with the first of them. Rows are sorted by group, homes first."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(fp)])
    n_homes = np.add.reduceat(home.astype(np.int64), starts)
    visitor = np.flatnonzero(~home)
    of = np.repeat(np.arange(len(starts)), sizes)[visitor]
    visitor, of = visitor[(keep := n_homes[of] > 0)], of[keep]
    label, work = np.arange(len(fp)), np.cumsum(n_homes[of])
    links = []
    for own in np.split(np.arange(len(visitor)), np.flatnonzero(np.diff((work - 1) // PAIRS)) + 1):
        which, at = ragged(starts[of[own]], starts[of[own]] + n_homes[of[own]])
        row = visitor[own][which]
        near = np.bitwise_count(fp[row] ^ fp[at]) <= bits
        links.append((row[near], at[near]))
    a, b = (np.concatenate([x[k] for x in links]) for k in (0, 1))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    tied = fp != fp[label]
    return fp[tied], fp[label[tied]]


def links(classes: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b) fingerprints in one component, of classes(fp) of different fingerprints; their components are those of all links."""
    spark = classes.sparkSession
    replicas = cut(_replicas(spark, classes, bits), "replicas")
    crowd = replicas.groupBy("anchor").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("visitors"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    hot = cut(crowd.where(F.col("visitors") > BLOCK).select("anchor", blocks("homes").alias("nh"), blocks("visitors").alias("nv")), "hot")
    each = replicas.join(broadcast_if(hot, hot.count(), BROADCAST_HOT), "anchor", "left")
    mine = lambda c: F.pmod(F.xxhash64("fp"), F.coalesce(c, F.lit(1))).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
    homes = each.where("home").select("anchor", mine("nh").alias("hb"), all_of("nv").alias("vb"), F.lit(0).alias("side"), "fp")
    visitors = each.select("anchor", all_of("nh").alias("hb"), mine("nv").alias("vb"), F.lit(1).alias("side"), "fp")
    keys = ["anchor", "hb", "vb"]
    dealt = homes.unionByName(visitors).repartition(*keys).sortWithinPartitions(*keys, "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # rows of a block whose end is still to come
        for b in chain(batches, [None]):
            rows = pa.Table.from_batches([x for x in (kept, b) if x is not None]) if kept or b else None
            if rows is None or not rows.num_rows:
                continue
            anchor, hb, vb, side, fp = (rows[c].to_numpy() for c in ("anchor", "hb", "vb", "side", "fp"))
            group = np.r_[0, np.cumsum((np.diff(anchor) != 0) | (np.diff(hb) != 0) | (np.diff(vb) != 0))]
            whole = len(fp) if b is None else int(np.searchsorted(group, group[-1]))
            kept = rows.slice(whole).combine_chunks().to_batches()[0] if whole < len(fp) else None
            if whole:
                x, y = _ties(fp[:whole].view(np.uint64), group[:whole], side[:whole] == 0, bits)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, bits: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id of every row of documents(doc_id, text)."""
    rows = cut(fingerprints(documents, shingle), "fingerprints")
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low_id")), "classes")
    labels = components(links(classes, bits))
    per_class = cut(classes.join(labels, classes["fp"] == labels["node"], "left").select("fp", "low_id", F.coalesce("component", "fp").alias("component")), "labels")
    ids = per_class.groupBy("component").agg(F.min("low_id").alias("component_id"))
    per_class = cut(per_class.join(ids, "component").select("fp", "component_id"), "components")
    return rows.join(per_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

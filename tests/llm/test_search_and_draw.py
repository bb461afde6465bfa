"""SimHash near-duplicates, ranked search and importance resampling against brute force, with odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkmill.llm import anchors, queries, ranked, resample

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Columns that operators use themselves, and a name with a dot.
SCHEMA = "doc_id long, text string, fp string, row string, q string, w string, term string, `a.b` string, rank string, anchor string, score string, h string"


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, *"abcdefghij") for i, t in pairs], SCHEMA)


def lowered(text):
    return (text or "").translate(str.maketrans(UP, LOW))


def long_text(seed, n=30_000):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 3000, n))


def corpus():
    """Copies, near copies, ties, nulls, repeated rows and ids, a very long text, separators only, other scripts."""
    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}" for a in "river stone cloud ember field lamp".split() for b in "s ed ing er".split()] + ["É", "ÉCOLE", "über"]
    docs = [" ".join(rng.choice(vocabulary, rng.integers(1, 120))) for _ in range(150)]
    base = docs[0] + " " + docs[1]
    near = [base.replace(" ", "  ", k % 3) + f" end{k}" for k in range(40)]
    odd = [None, "", " \t\n", "One", "one two", "ONE two", "x\x0by\x0cz", "日本 語 テスト 日本", "a" * 5000, long_text(1)]
    pairs = list(enumerate([*docs, *near, *odd, *([base] * 60)]))
    return [*pairs, pairs[3], pairs[3], (5, "another text of a repeated id"), (None, base), (None, None), (None, "lone words of nobody")]


# 11


def simhash(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, bits=3):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    every = sorted(parent)
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                parent[root(a)] = root(b)
    low = {}
    for i, p in zip(ids, prints, strict=True):
        if i is not None:
            low[root(p)] = min(i, low.get(root(p), i))
    return [low.get(root(p)) for p in prints]


@pytest.mark.parametrize("block", [anchors.BLOCK, 3])
def test_simhash(spark, monkeypatch, block):
    monkeypatch.setattr(anchors, "BLOCK", block)
    pairs = corpus()
    prints = [simhash(t) for _, t in pairs]
    want = sorted(map(repr, zip([i for i, _ in pairs], [f"{p:016x}" for p in prints], brute_components([i for i, _ in pairs], prints), strict=True)))
    got = anchors.near_duplicates(frame(spark, pairs)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    assert anchors.near_duplicates(frame(spark, [])).count() == 0


def test_every_pair_within_the_threshold_meets():
    """Each fingerprint visits the home of any other that differs in at most three bits, wherever they are."""
    rng = np.random.default_rng(11)
    fp = rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 300, dtype=np.uint64)
    cover = anchors.Cover(3)
    mine = cover.homes(fp)
    for flips in (0, 1, 2, 3):
        other = fp.copy()
        for i in range(len(fp)):
            for b in rng.choice(64, flips, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        seen = set()
        for which, anchor in cover.visits(other):
            seen |= set(zip(which.tolist(), anchor.tolist(), strict=True))
        assert all((i, a) in seen for i, a in enumerate(mine.tolist()))


def test_golay_code_is_perfect():
    """Every word of 23 bits has one code word within the radius; visits are distinct and within reach."""
    cover = anchors.Cover(3)
    words = np.random.default_rng(2).integers(0, 1 << 23, 2000)
    which, _ = cover.near(words, 0, 0)
    assert which.tolist() == list(range(2000))
    assert np.bincount(cover.remainders(np.arange(1 << 23)), minlength=2048).tolist() == [4096] * 2048
    fp = words[:50].astype(np.uint64) | words[50:100].astype(np.uint64) << np.uint64(23)
    seen = [(i, a) for which, anchor in cover.visits(fp) for i, a in zip(which.tolist(), anchor.tolist(), strict=True)]
    assert len(seen) == len(set(seen)) and 400 < len(seen) / 50 < 700


def test_simhash_links_across_blocks_of_a_crowded_anchor(spark, monkeypatch):
    """Hundreds of fingerprints around one anchor, in a grid of small blocks, give the same components as all pairs."""
    monkeypatch.setattr(anchors, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base, prints = 0x0123456789ABCDEF, set()
    while len(prints) < 300:
        p = base
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            p ^= 1 << int(b)
        prints.add(p)
    prints = sorted(prints) + [1, 2, 1 << 63]
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    ties = anchors.links(spark.createDataFrame(signed, "fp long")).collect()
    assert len(ties) < 300 * 330
    parent = {p: p for (p,) in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in ties:
        parent[root(a)] = root(b)
    groups = {}
    for p, (s,) in zip(prints, signed, strict=True):
        groups.setdefault(root(s), []).append(p)
    want = {}
    for i, (p, c) in enumerate(zip(prints, brute_components(range(len(prints)), prints), strict=True)):
        want.setdefault(c, []).append(p)
    assert sorted(groups.values()) == sorted(want.values())


# 12


def brute_ranking(docs, items, k=10):
    of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    counted = [(i, Counter(w), len(w)) for i, t in docs if (w := of(t))]
    n_docs, total, df = len(counted), sum(n for _, _, n in counted), Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        times, found = Counter(of(text)), []
        for i, c, n in counted:
            m = 100 - 75 + (75 * n * n_docs) // total
            score = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, x in times.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i, item))
        for r, (s, _, i, _) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.append((item, r, i, -s))
    return out


@pytest.mark.parametrize("shares", [(256, 16), (3,)])
def test_ranked(spark, tmp_path, monkeypatch, shares):
    monkeypatch.setattr(ranked, "ROWS", 37)
    monkeypatch.setattr(ranked, "RANKED_ROWS", 50)
    docs = corpus()
    items = [(1, docs[7][1]), (2, "river Rivers RIVERS nobody"), (3, "unheard"), (4, None), (5, ""), (6, "lone words of nobody"), (7, "日本 テスト"), (8, docs[40][1]), (2, "stoneer"), (9, long_text(1))]
    ranked.build_index(frame(spark, docs), str(tmp_path / "index"))
    index = ranked.read_index(spark, str(tmp_path / "index"))
    got = ranked.search(index, spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, q string, tier string"), shares=shares).collect()
    assert sorted(repr((r.item_id, r["rank"], r.doc_id, r.score)) for r in got) == sorted(map(repr, brute_ranking(docs, items)))
    for none_docs, none_items in ((docs[:0], items), (docs[150:152], [])):
        path = str(tmp_path / f"empty{len(none_items)}")
        ranked.build_index(frame(spark, none_docs), path)
        assert ranked.search(ranked.read_index(spark, path), spark.createDataFrame(none_items, "item_id long, text string")).count() == 0


def test_ranked_settles_what_is_proven_and_falls_through_otherwise(spark, tmp_path):
    """An item of rare terms is settled at the first tier, one of common terms alone at the last."""
    rng = np.random.default_rng(8)
    common = [f"c{k}" for k in range(40)]
    docs = [(i, " ".join(rng.choice(common, rng.integers(20, 60)))) for i in range(600)]
    docs += [(1000 + i, f"rare{i % 2} seldom scarce " + " ".join(rng.choice(common, 5 + i))) for i in range(25)]
    items = [(1, "rare0 rare1 seldom scarce c1"), (2, "c1 c2 c3 c4 c5 c6"), (3, "seldom nothing")]
    ranked.build_index(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "index"))
    got = ranked.search(ranked.read_index(spark, str(tmp_path / "index")), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == sorted(brute_ranking(docs, items))
    assert {(r.item_id, r.tier) for r in got} == {(1, 0), (2, 2), (3, 0)}


# 13


def brute_draw(docs, targets, percent=25, buckets=10_000):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
        return len(w), [zlib.crc32(x.encode()) % buckets for x in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]

    all_docs = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in all_docs for b in f), Counter(b for _, x in targets for b in features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, f in all_docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    may = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = [(*r[:4], k if k <= percent * len(may) // 100 else None) for k, r in enumerate(may, 1)]
    return rank + [(*r[:4], None) for r in rows if r[4] < 20]


def test_resampling(spark):
    docs = corpus()
    targets = [(1, docs[7][1]), (2, None), (3, "ÉCOLE über rivers")]
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    for more in ([], [(i, "tied words " * 30) for i in range(300, 500)]):
        got = resample.resample(frame(spark, docs + more), frame(spark, targets)).select(*columns).collect()
        assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, brute_draw(docs + more, targets)))
    assert resample.resample(frame(spark, []), frame(spark, targets)).count() == 0
    assert sorted(repr(tuple(r)) for r in resample.resample(frame(spark, docs), frame(spark, [])).select(*columns).collect()) == sorted(map(repr, brute_draw(docs, [])))


def test_resampling_scores_without_exploding(spark):
    plan = resample.scored(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), list(range(-50, 50)))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
    ranks = [r["rank"] for r in resample.resample(spark.range(200).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same words of a row " * 5).alias("text")), spark.createDataFrame([], "item_id long, text string")).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 51)) and ranks.count(None) == 150


@pytest.mark.parametrize("name", ["op11_simhash", "op12_ranked", "op13_resampling"])
def test_queries_give_whole_results(spark, sf, name):
    got = queries.queries()[name](spark, sf)
    want = {"op11_simhash": ["doc_id", "fingerprint", "component_id"], "op12_ranked": ["item_id", "rank", "doc_id", "score"], "op13_resampling": ["doc_id", "n_features", "weight", "score", "rank"]}[name]
    assert got.columns == want
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    if name == "op11_simhash":
        prints = [simhash(t) for _, t in docs]
        assert sorted(map(tuple, got.collect())) == sorted(zip([i for i, _ in docs], [f"{p:016x}" for p in prints], brute_components([i for i, _ in docs], prints), strict=True))
    else:
        assert got.count() > 0

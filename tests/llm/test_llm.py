"""Each training-data operator against brute force, library or held-out accuracy, with odd inputs."""

import hashlib
import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmill.llm import ann, common, decontaminate, graph, licences, neardup, pieces, quality, queries, tokens, toxicity, urls, warc

DOCS = "doc_id long, text string, fp string, score string, w string, key string, node string, word string, ids string, host string, components string"
EXTRA = ("a", "b", "c", "d", "e", "f", "g", "h", "i")
MODEL, TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/word_bpe_49k.json"
PROSE = [f"{a} {b} {c} {d} {e}" for a, b, c, d, e in zip("the of and to in is it for on that with as at by from".split(), "river stone cloud ember field lamp north ocean plain quill ridge slate tower umber vale".split(), "runs falls turns bends grows moves rests waits calls sings holds keeps finds takes makes".split(), "slowly gladly rarely softly nearly early fully truly kindly boldly calmly dimly evenly firmly gently".split(), "today tonight again alone below above beyond within without around across along behind beside between".split(), strict=True)]


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in pairs], DOCS)


def words(n, seed=0):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 10**6, n)]


# 1

def brute_nearest(rows, k=20):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    out = {}
    for i, q in good:
        if i % 20 == 0:
            near = sorted((-float(q @ v), j) for j, v in good if j != i)
            out[i] = [j for _, j in dict.fromkeys(near)][:k]
    return out


def test_ann(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(600, 16)).astype(np.float32)
    base[100:300] = base[100]  # a third is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [float("inf")] + [1.0] * 15), (1080, [None] + [1.0] * 15), (1100, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, list int, vk string")
    got = defaultdict(dict)
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    want = brute_nearest(rows[:-1])
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q].values()} & set(w)) for q, w in want.items())
    assert hits >= 0.9 * 20 * len(want)
    vectors = dict(rows)
    for q, ranked in got.items():
        assert sorted(ranked) == list(range(1, 21)) and q not in {v for v, _ in ranked.values()}
        for k in range(1, 21):
            v, s = ranked[k]
            assert s == pytest.approx(float(np.array(vectors[q], float) @ np.array(vectors[v], float)), abs=1e-9)
            assert k == 1 or (-ranked[k - 1][1], ranked[k - 1][0]) < (-s, v)
    assert got[100] and [got[100][k][0] for k in range(1, 20)] == list(range(101, 120))
    few = df.where("vec_id IN (0, 1, 2)")
    assert [(r.query_id, r["rank"]) for r in ann.search(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert ann.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_ann_rows_of_one_id_and_other_lengths(spark):
    """A query's own row alone is left out, and vectors of each length are searched among themselves."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    rows += [(20, [3 * x for x in rows[20][1]]), (40, rows[40][1]), (40, rows[40][1]), (7, rows[20][1])] + [(i, [1.0 + i, 2.0, -1.0]) for i in (0, 20, 500, 501)]
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = defaultdict(list)
    for at, (i, v) in enumerate(rows):
        if i % 20 == 0:
            near = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), j) for b, (j, w) in enumerate(rows) if b != at and len(w) == len(v))[:20]
            want[i] += [(k, j, -s) for k, (s, j) in enumerate(near, 1)]
    assert got.keys() == want.keys()
    for i in got:
        one, two = sorted(got[i]), sorted(want[i])
        assert [x[0] for x in one] == [x[0] for x in two] and np.allclose([x[2] for x in one], [x[2] for x in two])
    assert {j for _, j, _ in got[20]} >= {20, 7} and {j for _, j, _ in got[40]} >= {40}


def test_ann_walk_finds_the_nearest_centroids():
    x = np.random.default_rng(1).normal(size=(12_000, 12))
    c = ann.fit_centroids(x, 2400, 2)
    assert len(c) == 2400 and ann.SEEDS == 8
    ids, d = ann.walk(x[:200], c, ann.build_graph(c), 40)
    exact = ann.squared(x[:200], c)
    assert (ids[:, 0] == exact.argmin(1)).mean() >= 0.95 and (np.diff(d, axis=1) >= 0).all()


def test_ann_prunes_lists(spark):
    """Recall of 0.9 from a few of many lists."""
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(60, 24))[rng.integers(0, 60, 20_000)] + 0.5 * rng.normal(size=(20_000, 24))).astype(np.float32)
    df = spark.createDataFrame(enumerate(base.tolist()), "vec_id long, embedding array<float>").repartition(4)
    report = {}
    got = defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 100 == 0, report=report).collect():
        got[r.query_id].add(r.vec_id)
    assert report["lists"] >= 200 and report["read"] <= 0.3 * report["lists"] * report["queries"]
    x, hits = base.astype(float), 0
    for q in range(0, 20_000, 100):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(got[q] & set(np.argpartition(-score, 20)[:20].tolist()))
    assert len(got) == 200 and hits >= 0.9 * 20 * 200


def test_ann_bounds_leave_the_answers(spark, monkeypatch):
    """What scores less than a query's bound stays behind, and what is found is the same as without bounds."""
    one = (np.ones((1, 2)), np.zeros(1, int), np.zeros(1, int))
    assert ann.bounds(*one, np.array([[1.0, 0], [2, 0], [3, 0]]), [np.arange(3)], 2, 9.0)[0] == pytest.approx(2.0, abs=1e-6)
    assert ann.bounds(*one, np.ones((1, 2)), [np.arange(1)], 2, 9.0)[0] == -np.inf
    base = np.random.default_rng(11).normal(size=(4000, 12)).round(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    found = sorted(map(tuple, ann.search(df, F.col("vec_id") % 20 == 0).collect()))
    real = ann._assigned
    monkeypatch.setattr(ann, "_assigned", lambda *a: real(*a).withColumn("low", F.lit(float("-inf"))))
    assert sorted(map(tuple, ann.search(df, F.col("vec_id") % 20 == 0).collect())) == found


# 2

def brute_overlaps(docs, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, t in docs:
        w, hit, names = cut(t), set(), set()
        for name, text in items:
            v = cut(text)
            n = min(window, len(v))
            wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    names.add(name)
        named = sorted(str(n) for n in names if n is not None)
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest()))
    return out


def test_decontamination(spark):
    item = words(25, 1)
    docs = [
        (1, " ".join(words(30, 2) + item[3:15] + words(5, 3))), (2, " ".join(item[:9])), (3, None), (4, ""), (5, "Hello, WORLD! É x"), (5, "hello world again"), (None, " ".join(item)),
        (None, " ".join(item)), (6, " ".join(item * 40)), (7, " ".join(item[5:16] + ["zz"] + item[5:16])), (8, "one two three four five six"), (9, "É é"),
    ]
    items = [(10, " ".join(item)), (9, " ".join(item)), (9, " ".join(item)), (11, "Hello world"), (12, "É"), (13, None), (14, ""), (None, "two three four five six"), (15, "x x x")]
    d, b = frame(spark, docs), spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, words string")
    got = decontaminate.overlaps(d, b).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256))
    key = lambda r: json.dumps(r)
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, brute_overlaps(docs, items)))
    clean = decontaminate.decontaminate(d, b)
    assert clean.columns == d.columns and sorted(r.doc_id for r in clean.collect()) == sorted(i for (i, t), o in zip(docs, brute_overlaps(docs, items), strict=True) if not o[2])
    assert decontaminate.overlaps(d, b.where("false")).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.overlaps(d.where("false"), b).count() == 0


# 3

def test_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["", None, "  a  b\n\nc", "<|endoftext|>x", "it's I'LL É́ ÀB", "a b\tc\r\n d", "İSTANBUL ΟΔΟΣ.", "x" * 3000, "don 't 're", "a~b ~ ~~", "word, " * 5000, "Thé, thé. THÉ"]
    docs = [(i * 3 % 11, t) for i, t in enumerate(texts)] + [(None, "no id")]
    t = Tokenizer.from_file(TOKENIZER)
    want = sorted(((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 1])) for i, x in docs), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1])))
    tokens.write_ids(frame(spark, docs), str(tmp_path / "ids"), TOKENIZER)
    got = tokens.read_ids(spark, str(tmp_path / "ids"), with_ids=True).orderBy("start").collect()
    assert sorted((r.doc_id or -1, tuple(r.ids)) for r in got) == sorted((i if i else -1, x) if i is not None else (-1, x) for i, x in want) or sorted(tuple(r.ids) for r in got) == sorted(x for _, x in want)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i or 0))
    tokens.write_ids(frame(spark, docs).where("false"), str(tmp_path / "none"), TOKENIZER)
    assert tokens.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for ids in (np.empty(0, np.uint32), np.array([5], np.uint32), np.zeros(1000, np.uint32), rng.integers(0, 9, 5000).astype(np.uint32), rng.integers(0, 2**24 - 1, 3000).astype(np.uint32)):
        sizes = np.array([len(ids) // 3, 0, len(ids) - len(ids) // 3])
        s = tokens.Shard(tokens.Shard.pack([4, None, 6], sizes, ids))
        assert (s.all_ids() == ids).all() and (s.document(2) == ids[len(ids) // 3 :]).all() and len(s.document(1)) == 0
        for _ in range(20):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2))
            assert (s.ids(a, b) == ids[a:b]).all()
    assert len(tokens.compress(np.tile([1, 2, 3, 4], 1000).astype(np.uint32))[0]) < 40
    # No pair that stands often enough is left, and blocks give the same ids.
    text = np.random.default_rng(1).zipf(1.5, 60_000).clip(1, 3000).astype(np.uint32)
    symbols, rules, lengths = tokens.compress(text)
    _, count = np.unique(symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:], return_counts=True)
    assert count.max() < tokens.LEAST_COUNT and (tokens.expand(symbols, rules) == text).all() and lengths.max() >= 8
    s = tokens.Shard(tokens.Shard.pack([1], np.array([len(text)]), text))
    assert (s.all_ids() == text).all() and all((s.ids(a, a + 700) == text[a : a + 700]).all() for a in range(0, 59_000, 1777))


# 4

def test_licences(spark):
    lines = {1: "Licensed under the Apache License, Version 2.0.", 2: "Released under the MIT License.", 3: "This work is licensed under the GNU General Public License, version 3.", 4: "Licensed under CC BY-NC 4.0."}
    docs = [(i, f"{PROSE[i]}\n{t}\n{PROSE[i + 1]}") for i, t in lines.items()] + [(5, None), (6, ""), (7, "The driver has a license to version the terms under the law"), (8, lines[1] + "\n" + lines[2]), (8, lines[1])]
    docs += [(100 + k, "\n".join(PROSE[(k + j) % 15] for j in range(4))) for k in range(60)]
    d = frame(spark, docs)
    out = defaultdict(set)
    for r in licences.scan_documents(d).collect():
        out[r.doc_id].add(r.families)
    assert [out[k] for k in range(1, 9)] == [{"apache"}, {"mit"}, {"gpl"}, {"cc"}, {""}, {""}, {""}, {"apache,mit"}]
    assert all(out[100 + k] == {""} for k in range(60))
    assert licences.scan_documents(d.where("false"), licences.train(d)).count() == 0


def test_licences_held_out_edits(spark):
    """Precision and recall on edits that the training has none of: misspelt words, other words left out, words around."""
    rng, docs, want = np.random.default_rng(8), [], {}
    for family, texts in sorted(licences.TEMPLATES.items()):
        for text in texts:
            for kind in range(3):
                w = text.split()
                if kind == 0 and len(w) >= 6:
                    at = int(rng.integers(1, len(w) - 1))
                    w[at] = w[at][:-1] + "qz"
                elif kind == 1 and len(w) >= 8:
                    del w[int(rng.integers(1, len(w) - 1))]
                elif kind == 2:
                    w = [*PROSE[len(docs) % 15].split(), *w, *PROSE[(len(docs) + 4) % 15].split()]
                want[len(docs)] = family
                docs.append((len(docs), " ".join(w)))
    docs += [(1000 + k, "\n".join(" ".join(rng.permutation(" ".join(PROSE).split())[:9]) for _ in range(4))) for k in range(150)]
    got = {r.doc_id: set(filter(None, r.families.split(","))) for r in licences.scan_documents(frame(spark, docs)).collect()}
    named = [(i, f) for i, found in got.items() for f in found]
    right = sum(want.get(i) == f for i, f in named)
    assert right >= 0.95 * len(want) and right >= 0.85 * len(named) and not any(got[1000 + k] for k in range(150)), (right, len(want), len(named))


def test_licences_within_longer_lines(spark):
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    prose = " ".join(PROSE)
    notices = ["Licensed under CC BY-NC 4.0.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"]
    docs = [(1, apache), (2, mit), (3, "All code in this repository is Released under the MIT License. See the file for details."), (4, f"{prose} {notices[0]} {prose} {notices[1]} {prose}"), (5, f"{apache} {prose} {mit}"), (6, prose)]
    docs += [(7, "The driver has a license to version the terms under the law, and the software of this person is subject to the terms of the source"), (8, f"{prose} {notices[0]} {prose}\n{apache}"), (8, f"{notices[0]} {prose}\n{apache}")]
    docs += [(100 + k, "\n".join(PROSE[(k + j) % 15] for j in range(4))) for k in range(60)]
    out = defaultdict(set)
    for r in licences.scan_documents(frame(spark, docs)).collect():
        out[r.doc_id].add((r.families, r.n_paragraphs))
    assert [out[k] for k in range(1, 9)] == [{("apache", 1)}, {("mit", 1)}, {("mit", 1)}, {("cc,gpl", 1)}, {("apache,mit", 1)}, {("", 0)}, {("", 0)}, {("apache,cc", 3)}]
    assert all(out[100 + k] == {("", 0)} for k in range(60))


def test_licences_learn_from_every_line(spark):
    """All lines of a corpus far beyond 6,000 are counted, and the threshold is that of all of them."""
    rows = spark.range(200_000).select((F.col("id") / 200_000).alias("chance"), F.lit(3.0).alias("n"))
    assert licences._highest(rows, 0.999) == pytest.approx(0.999, abs=1e-5)
    text = F.concat_ws("\n", *(F.concat(F.lit(f"the word{k} of stone"), F.col("id").cast("string")) for k in range(10)))
    seen = []
    real = licences.cut
    try:
        licences.cut = lambda df, name: seen.append((name, real(df, name))) or seen[-1][1]
        licences.train(spark.range(2000).select(F.col("id").alias("doc_id"), text.alias("text")))
    finally:
        licences.cut = real
    assert dict(seen)["unknown"].agg(F.sum("n")).first()[0] == 20_000


# 5 and 6

def labelled(spark, make_bad, n=240):
    rng = np.random.default_rng(9)
    docs, labels = [], []
    for i in range(n):
        w = list(rng.choice(" ".join(PROSE).split(), 40))
        bad = i % 4 == 0
        docs.append((i, make_bad(w, rng) if bad else " ".join(w)))
        labels.append((i, int(bad)))
    return docs, labels


@pytest.mark.parametrize("which", ["toxic", "quality"])
def test_classifiers(spark, which):
    if which == "toxic":
        docs, labels = labelled(spark, lambda w, rng: " ".join([*w[:20], rng.choice(["vilezog", "vilezark", "vileze"]), *w[20:], "gronkish"]))
        module, threshold, flip = toxicity, 0.5, 0
    else:
        docs, labels = labelled(spark, lambda w, rng: " ".join(x.upper() + "!!" for x in w) if rng.random() < 0.5 else " ".join(x for x in w[:8] for _ in range(5)))
        module, threshold, flip = quality, 0.3, 1
    d = frame(spark, [*docs, (9000, None), (9001, ""), (9002, "x" * 100_000), (None, docs[1][1]), docs[0]])
    y = spark.createDataFrame([(i, v ^ flip, "q") for i, v in labels] + [(9000, None, "q"), (123456, 1, "q")], f"doc_id long, {which} int, text string")
    model = module.train(d, y)
    scored = module.score(d, model)
    assert scored.columns == d.columns
    got = scored.select("doc_id", "text", "score", quality.held_out(F.col("doc_id")).alias("held")).collect()
    assert len(got) == len(docs) + 5 and all(0 <= r.score <= 1 for r in got)
    truth = {i: v ^ flip for i, v in labels}
    held = [(truth[r.doc_id], int(r.score >= threshold)) for r in got if r.held and r.doc_id in truth]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) >= 0.93
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    kept = module.accept(d, y, threshold)
    assert kept.columns == d.columns and kept.where("score <> 'b'").count() == 0 and 0 < kept.count() < d.count()
    # Without labels, or with one class, nothing fails.
    for some in (y.where("false"), y.where(F.col(which) == 1)):
        assert module.score(d, module.train(d, some)).where("score >= 0 AND score <= 1").count() == len(docs) + 5
    assert module.score(d.where("false"), model).count() == 0


def test_toxicity_ratios_are_kneser_ney(spark, monkeypatch):
    """Ratios against the definition over dictionaries, and the joined way against the broadcast one."""
    counts = {"river": (2.0, 0.5, 9), "rivers": (0.0, 3.0, 5), "é1": (1.0, 0.0, 1), "a": (0.0, 0.0, 4), "ravine": (0.5, 1.5, 2)}
    levels = {toxicity.ORDER: defaultdict(lambda: np.zeros(3))}
    for word, c in counts.items():
        padded = toxicity.LEFT + word + toxicity.RIGHT
        for i in range(len(word) + 1):
            levels[toxicity.ORDER][padded[i : i + toxicity.ORDER]] += c
    for n in range(toxicity.ORDER - 1, 0, -1):
        levels[n] = defaultdict(int)
        for g in levels[n + 1]:
            levels[n][g[1:]] += 1

    def shared(g):
        table = {k: (v[2] if len(g) == toxicity.ORDER else v) for k, v in levels[len(g)].items()}
        if len(g) == 1:
            return (table[g] + 0.5) / (sum(table.values()) + 0.5 * toxicity.ALPHABET)
        own = [v for k, v in table.items() if k[:-1] == g[:-1]]
        return (max(table[g] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(own) * shared(g[1:])) / sum(own)

    def of_class(g, k):
        own = [v[k] for x, v in levels[toxicity.ORDER].items() if x[:-1] == g[:-1]]
        c = levels[toxicity.ORDER][g][k]
        return (max(c - toxicity.DISCOUNT, 0) + (toxicity.DISCOUNT * sum(v > 0 for v in own) + toxicity.PRIOR) * shared(g)) / (max(sum(own), c) + toxicity.PRIOR)

    table = spark.createDataFrame([(w, *c) for w, c in counts.items()], "word string, t double, o double, c long")
    got = {r.g: r.ratio for r in toxicity.gram_ratios(table).collect()}
    assert set(got) == set(levels[toxicity.ORDER])
    for g, ratio in got.items():
        assert ratio == pytest.approx(np.log(of_class(g, 0)) - np.log(of_class(g, 1)), abs=1e-9)

    docs = [(i, f"{PROSE[i % 15]} {'vile' if i % 3 == 0 else 'fine'} river") for i in range(60)] + [(70, None), (71, ""), (None, PROSE[1]), (3, PROSE[3])]
    d, y = frame(spark, docs), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    scores = []
    for most in (toxicity.BROADCAST_GRAMS, 0):
        monkeypatch.setattr(toxicity, "BROADCAST_GRAMS", most)
        scored = toxicity.score(d, toxicity.train(d, y))
        assert scored.columns == d.columns
        scores.append(sorted((str(r.doc_id), str(r.text), r.score) for r in scored.collect()))
    assert [x[:2] for x in scores[0]] == [x[:2] for x in scores[1]]
    assert np.allclose([x[2] for x in scores[0]], [x[2] for x in scores[1]], atol=1e-3)


# 7

def test_urls(spark):
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "", "block"), ("Example.NET", "/x", "allow"), ("a.b", "/", "block"), ("a.b", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    cases = {
        "http://Blog.Example.com/en/712#t": ("blog.example.com", "/en/712", "example.com/en/7", "allow"),
        "https://example.com/en/8": ("example.com", "/en/8", "com/en/", "block"),
        "https://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "x://net": ("net", "", "net", "block"), "x://example.net/xy?z": ("example.net", "/xy", "example.net/x", "allow"), "x://c.a.b/": ("c.a.b", "/", "a.b/", "block"),
        "x://a.b": ("a.b", "", None, "allow"), "://?q": ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "x://h.com/" + "p" * 50_000: ("h.com", "/" + "p" * 50_000, None, "allow"), "x://.com/en/": (".com", "/en/", "com/en/", "block"),
    }
    pages = spark.createDataFrame([(u, "h", "p") for u in [*cases, "x://net"]], "url string, host string, path string")
    got = urls.filter_urls(pages, rules).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.url]
    assert {r.verdict for r in urls.filter_urls(pages, rules.where("false")).collect()} == {"allow"} and urls.filter_urls(pages.where("false"), rules).count() == 0


# 8

def test_warc(spark, tmp_path):
    html = '<html lang="fr"><head><title>A &amp; B</title><script>x("<p>")</script></head><body><!-- no --><p>Un &eacute;<br>deux</p><a href="/x?a=1&amp;b=2">l</a></body></html>'
    pages = spark.createDataFrame([(1, "http://a/", html, "z"), (2, None, None, "z"), (3, "http://b/", "plain <", "z"), (3, "http://b/", "plain <", "z"), (4, "x", "WARC/1.1\r\n\r\n" * 3, "z")], "page_id long, url string, html string, block string")
    responses = warc.responses(pages)
    made = warc.derive(responses)
    parent = {r.record_id: r for r in responses.collect()}
    assert made.count() == 10
    for r in made.collect():
        p = parent[r.refers_to]
        assert (p.page_id, p.target_uri, p.warc_date) == (r.page_id, r.target_uri, r.warc_date) and r.content_length == len(r.block.encode())
        import base64

        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(r.block.encode()).digest()).decode()
        if r.page_id == 1 and r.warc_type == "conversion":
            assert r.block == "A & B\nUn é\ndeux\nl"
        if r.warc_type == "metadata":
            m = json.loads(r.block)
            assert m["envelope"]["source-record"] == r.refers_to and m["envelope"]["source-payload-digest"] == p.payload_digest
            if r.page_id == 1:
                page = m["page"]
                assert page.pop("http-status") == "HTTP/1.1 200 OK" and dict(page.pop("http-headers"))["Content-Type"] == "text/html; charset=utf-8"
                assert page == {"title": "A & B", "lang": "fr", "n_links": 1, "links": ["/x?a=1&b=2"]}
    warc.write_warc(made.unionByName(responses), str(tmp_path / "w"), 3)
    back = warc.read_warc(spark, str(tmp_path / "w"))
    assert sorted(map(str, back.collect())) == sorted(map(str, made.unionByName(responses).select(*back.columns).collect()))
    assert sorted(map(str, warc.scan_warc(spark, str(tmp_path / "w" / "files")).collect())) == sorted(map(str, back.collect()))
    one = warc.read_warc(spark, str(tmp_path / "w"), "warc_type = 'conversion'").collect()
    assert len(one) == 5 and {r.warc_type for r in one} == {"conversion"}
    warc.write_warc(made.where("false"), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0
    assert warc.derive(warc.responses(pages.where("false"))).count() == 0


def test_warc_scans_are_linear(spark, tmp_path):
    import time

    began = time.perf_counter()
    for unit in ("<a", "<a ", "<p ", "<title ", "<html ", "<a <b >", "<!-- ", "<script>", "<a href='x ", "</script "):
        source = unit * (2_000_000 // len(unit))
        warc.page_text(source)
        warc.page_metadata(source)
    assert time.perf_counter() - began < 40
    assert warc.page_text("a < b <a") == "a < b <a" and json.loads(warc.page_metadata("<title>x</title><a class=c href=y>z</a><a href>"))["links"] == ["y"]
    empty = spark.createDataFrame([(None,) * 11], warc.FIELDS)
    warc.write_warc(empty, str(tmp_path / "null"))
    assert [r.block for r in warc.read_warc(spark, str(tmp_path / "null")).collect()] == [""]


def test_warc_query_keeps_the_blocks(spark, sf):
    rows = queries.op8_warc(spark, sf).collect()
    assert {r.warc_type for r in rows} == {"conversion", "metadata"}
    assert all(r.content_length == len(r.block.encode()) for r in rows)
    assert all("source-content-type" in r.block for r in rows if r.warc_type == "metadata")


# 10


def test_components_leave_no_turns_behind(spark, tmp_path, monkeypatch):
    """Of all turns only the last one's tables stay, in as many files as they need."""
    made = iter(range(1000))
    monkeypatch.setattr(graph, "scratch", lambda _, name: f"{tmp_path}/{name}-{next(made)}")
    chain = spark.range(0, 40).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.range(100, 110).selectExpr("id AS a", "CAST(100 AS long) AS b"))
    got = {r.node: r.component for r in graph.components(chain).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 110), 100)}
    assert next(made) > 3 and len(list(tmp_path.iterdir())) == 1
    assert len(list(tmp_path.rglob("part-*.parquet"))) == 4


# 9

TEXTS = ["", None, "  a b", "a\n\tb  c ", "a　b", "é é ﬁ 👍", "<s> </s> <unk> <0x41>", "▁▁x", "x" * 500, "abcdefghijklmnopqrstuvwxyz" * 20, "日本語テキスト " * 3, " ", "\n", "a  \n b   ", " " * 40, "The River, runs. AKIA5BAMY 123", *PROSE]


@pytest.mark.parametrize("hot", [1 << 19, 3])
def test_pieces(spark, hot, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, "HOT_WORDS", hot)
    sp, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.read_model(MODEL)
    docs = [*enumerate(TEXTS), (None, "no id"), (3, TEXTS[3]), (3, "other")]
    d = frame(spark, docs)
    got = pieces.decode(pieces.encode_ids(d, model), model)
    assert set(d.columns) < set(got.columns)
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert list(r.ids) == sp.encode(r.text or "") and r.decoded == sp.decode(list(r.ids)) and r.decoded == (r.text or "").replace("▁", " ")
    assert pieces.encode_ids(d.where("false"), model).count() == 0
    odd = spark.createDataFrame([(1, "a b", 7, 8, "x"), (2, None, 9, 9, "y")], "doc_id long, text string, did int, fp int, rare string")
    assert {(r.did, r.fp, r.rare, tuple(r.ids)) for r in pieces.encode_ids(odd, model).collect()} == {(7, 8, "x", tuple(sp.encode("a b"))), (9, 9, "y", ())}


def test_pieces_moves_no_text(spark):
    """Where the caller doesn't ask for the texts, no text or other string goes into the join with the rare words' pieces."""
    d = frame(spark, list(enumerate(TEXTS)))
    plan = pieces.encode_ids(d, pieces.read_model(MODEL)).select("doc_id", "ids")._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    side = plan.children().apply(0).output()
    kinds = [side.apply(k).dataType().typeName() for k in range(side.size())]
    assert len(kinds) >= 4 and "string" not in kinds


def test_pieces_of_rare_words_meet_documents_as_a_row_each(spark):
    """They are gathered by row before, so no aggregation stands between the written rows and the join with documents."""
    d = frame(spark, list(enumerate(TEXTS)))
    plan = pieces.encode_ids(d, pieces.read_model(MODEL)).select("doc_id", "ids")._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    assert "Aggregate" not in plan.toString()


def test_frequent_words_are_found_by_hash_and_compared(monkeypatch):
    import numpy as np
    import pyarrow as pa

    words, asked = pa.array(["the", "▁a", "é", "👍"]), pa.array(["é", "x", "the", "👍", "", "▁a"])
    assert pieces.Names(words).find(asked).tolist() == [2, -1, 0, 3, -1, 1]
    assert pieces.Names(words.slice(0, 0)).find(asked).tolist() == [-1] * 6
    monkeypatch.setattr(pieces.Names, "_hashes", staticmethod(lambda w: np.array([len(x) % 2 for x in w.to_pylist()], np.uint64)))
    assert pieces.Names(words).find(asked).tolist() == [2, -1, 0, 3, -1, 1]


def test_python_workers_get_small_batches(spark, monkeypatch):
    """The pipeline's steps bound what Spark sends to a Python worker at a time by bytes; a session's own bound stays."""
    import corpus_pipeline
    import pyarrow as pa

    own = spark.newSession()
    monkeypatch.setattr(neardup, "deduplicate", lambda docs: docs)
    d = own.createDataFrame([(k, "x" * 1_000_000) for k in range(24)], "doc_id long, text string").coalesce(1)
    corpus_pipeline.near_duplicates_stage(own, d, "")
    sizes = [r.n for r in d.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()]
    assert sum(sizes) == 24 and max(sizes) <= 9
    own.conf.set(common.BATCH, "1m")
    common.small_batches(own)
    assert own.conf.get(common.BATCH) == "1m"


def test_pieces_pack_word_numbers_by_size():
    """The numbers that move in place of ids take a byte below 128, two below 16384, and come back row by row."""
    import numpy as np

    rows = [[], [0, 1, 127], [128, 16383], [], [16384, 1 << 19, 1 << 21, 1 << 28, (1 << 31) - 1], []]
    ends = np.cumsum([0, *map(len, rows)])
    packed = pieces._packed(np.array([x for r in rows for x in r], np.int64), ends)
    assert [len(x) for x in packed.to_pylist()] == [0, 3, 4, 0, 3 + 3 + 4 + 5 + 5, 0]
    numbers, begins = pieces._unpacked(packed)
    assert [numbers[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)] == rows


def test_pieces_cuts_texts_as_the_pattern_does():
    import pyarrow as pa

    model = pieces.read_model(MODEL)
    find = re.compile(pieces.word_pattern(model["pieces"], pieces.PYTHON_CODE)).findall
    texts = [*TEXTS, "\ufdd0 a\ufdd0 b", "a\nb", "a,\nb!", "a\n\nb c,;\nd", "x,y z", "a1 b2", "\x00 a", "▁ x ▁ y"]
    words, word, starts, part, off = pieces.Cutter(model["pieces"])(pa.array(texts))
    words = words.to_pylist()
    for t, a, b in zip(texts, off[:-1], off[1:], strict=True):
        got = [words[k] for p in part[a:b] for k in word[starts[p] : starts[p + 1]]]
        assert got == (find(pieces.MARK + t.replace(" ", pieces.MARK)) if t else [])


def test_pieces_query_gives_ids_and_text(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op9_pieces(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert list(r.ids) == sp.encode(texts[r.doc_id]) and r.decoded == sp.decode(list(r.ids))


def test_unigram_lattice_is_the_best_path(spark):
    chars = "abcd"
    rng = np.random.default_rng(4)
    inventory = {c: float(-8 - k) for k, c in enumerate("abc")} | {"".join(rng.choice(list(chars), n)): float(-rng.integers(3, 20)) for n in (2, 2, 2, 3, 3, 4)}
    model = {"pieces": [("<unk>", 0, 0.0, pieces.UNKNOWN), *((p, k + 1, s, pieces.NORMAL) for k, (p, s) in enumerate(inventory.items()))], "bpe": False}
    texts = ["".join(rng.choice(list(chars), n)) for n in (*range(1, 12), 40)]

    def best(t):
        unknown, score = min(inventory.values()) - 10, [0.0] + [-1e300] * len(t)
        for e in range(1, len(t) + 1):
            for s in range(max(0, e - 4), e):
                own = inventory.get(t[s:e], unknown if e - s == 1 else None)
                if own is not None:
                    score[e] = max(score[e], score[s] + own)
        return score[-1]

    names = {k: (p, s) for p, k, s, _ in model["pieces"]}
    out = pieces.encode_words(spark.createDataFrame([(t,) for t in texts], "word string"), pieces.piece_table(spark, model), model).collect()
    assert sorted(r.word for r in out) == sorted(texts)
    for r in out:
        total = sum(names[i][1] if i else min(inventory.values()) - 10 for i in r.ids)
        assert total == pytest.approx(best(r.word)) and sum(len(names[i][0]) if i else 1 for i in r.ids) == len(r.word)


# 10

def brute_groups(docs, percent=75):
    sets = []
    for i, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()))
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(s), low.get(find(k))) for k, (i, s) in enumerate(sets)), key=str)


def test_near_duplicates(spark):
    rng = np.random.default_rng(2)
    base, passage = words(120, 7), words(60, 8)
    docs = [(500 - i, " ".join(words(60, 100 + i))) for i in range(10)]
    for i in range(70):  # near copies with few to many edits
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 9)):
            w[k] = f"e{rng.integers(10**6)}"
        docs.append((1000 + i, " ".join(w)))
    docs += [(2000 + i, " ".join(words(int(rng.integers(5, 60)), 300 + i) + passage)) for i in range(60)]  # a shared passage
    docs += [(3000, " ".join(base)), (3001, " ".join(base).upper()), (3002, "\t" + "\n".join(base) + "  "), (4000, None), (4001, ""), (4002, " \n"), (5000, "a b"), (5001, "A  b"), (5002, "a b c"), (None, "a b"), (None, "q r s t u v"), (6000, "É x y z"), (6001, "é x y z"), (7000, " ".join(words(6000, 9))), (7001, " ".join(words(6000, 9)[:5900])), (7001, " ".join(words(6000, 9)[:5900]))]
    d = frame(spark, docs)
    got = neardup.near_duplicates(d)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute_groups(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())
    kept = neardup.deduplicate(d)
    assert kept.columns == d.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and set(ids) == {c for i, _, c in brute_groups(docs) if i == c and i is not None}
    assert neardup.near_duplicates(d.where("false")).count() == 0 and neardup.deduplicate(d.where("false")).count() == 0


def test_near_duplicates_with_repeated_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PAIRS", 2)
    text = lambda k: " ".join(words(40, k))
    near = lambda t, k: t.replace(t.split()[0], f"n{k}")
    a, b, c, d, e, f, g, h, i = map(text, range(61, 70))
    cases = [
        ([(5, a), (5, b), (3, a + " "), (7, b)], {(3, a + " "), (5, b)}),
        ([(15, c), (15, d), (13, near(c, 1)), (19, e)], {(13, near(c, 1)), (15, d), (19, e)}),
        ([(105, f), (105, f), (106, f), (105, "")], {(105, f), (105, "")}),
        ([(None, g), (108, near(g, 1)), (104, g)], {(104, g)}),
        ([(k, near(h, k)) for k in range(220, 232)], {(220, near(h, 220))}),
    ]
    docs = [x for rows, _ in cases for x in rows] + [(None, i), (None, near(i, 2)), (1, None), (1, None)]
    table = frame(spark, docs)
    got = neardup.near_duplicates(table).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_groups(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    rows = [(r.doc_id, r.text) for r in neardup.deduplicate(table).collect()]
    assert sorted(x for x in rows if x[0] and x[0] > 1) == sorted(x for _, left in cases for x in left)
    assert rows.count((1, None)) == 2 and [r[0] for r in rows].count(None) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 77), (5, 5), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 77: 50, 100: 50}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# the pipeline

def test_pipeline_stages(spark, sf):
    import corpus_pipeline
    from inkmill.llm.common import table

    docs = table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "pieces"]
    left = corpus_pipeline.near_duplicates_stage(spark, docs, sf)
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {c for i, _, c in brute_groups(pairs) if i == c}
    clean = corpus_pipeline.decontamination_stage(spark, docs, sf)
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {o[0] for o in brute_overlaps(pairs, items) if not o[2]}
    labels = table(spark, sf, "labels")
    odd = docs.unionByName(docs.limit(1)).unionByName(spark.createDataFrame([(None, None, "en", "s", 0), (-1, "", "en", "s", 0)], docs.schema)).withColumns({"score": F.lit("kept"), "ids": F.lit("kept"), "fp": F.lit("kept")})
    for stage, module, decide in ((corpus_pipeline.quality_stage, quality, "score >= 0.3"), (corpus_pipeline.toxicity_stage, toxicity, "score < 0.5")):
        some = stage(spark, odd, sf)
        scored = module.score(odd.drop("score"), module.train(odd, labels)).where(decide)
        assert some.columns == odd.columns and 0 < some.count() < odd.count() and {r.score for r in some.select("score").distinct().collect()} == {"kept"}
        assert sorted(str(r.doc_id) for r in some.collect()) == sorted(str(r.doc_id) for r in scored.collect())
        assert stage(spark, odd.where("false"), sf).count() == 0
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    cut = {r.doc_id: r for r in corpus_pipeline.pieces_stage(spark, odd.where("doc_id < 20 OR doc_id IS NULL"), sf).collect()}
    for i, text in [(None, None), (-1, ""), *[p for p in pairs if p[0] < 20]]:
        assert list(cut[i].ids) == sp.encode(text or "") and cut[i].n_pieces == len(cut[i].ids)
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() < docs.count() and out.where("n_pieces <> size(ids)").count() == 0

"""Embedding by batches, rankings, fusion and metrics against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmill.operators import embedding, retrieval

DOCS = [(1, "red fish blue fish"), (2, "one fish two"), (3, "RED fox"), (4, None), (5, ""), (6, "blue fox red fish"), (7, "red fox")]
QUERIES = [(10, "red fish"), (11, "fox"), (12, "nothing"), (13, "two red red")]


def test_embed(spark):
    df = spark.createDataFrame([(k, f"t{k}" if k % 5 else None, "x") for k in range(40)], "id int, text string, `a.b` string")
    for broken, message in ((lambda t: [[1.0]] * (len(t) - 1), "vectors"), (lambda t: [[1.0]] * (len(t) - 1) + [None], "missing"), (lambda t: [[1.0], *[[1.0, 2.0]] * (len(t) - 1)], "ragged"), (lambda t: [], "vectors"), (lambda t: [[float("nan")] for _ in t], "finite")):
        with pytest.raises(Exception, match=message):
            embedding.embed(df, broken, wait=0).collect()

    def sometimes(texts):
        calls["n"] += 1
        if calls["n"] % 2:
            raise OSError("not now")
        return [[float(t[1:]), 2.0] for t in texts]

    calls = Counter()
    got = {r.id: r for r in embedding.embed(df, sometimes, batch=7, wait=0).collect()}
    assert all((r.embedding == [float(k), 2.0] if k % 5 else r.embedding is None) and r["a.b"] == "x" for k, r in got.items()) and len(got) == 40


def test_hash_embedding(spark):
    got = {r.doc_id: r.v for r in spark.createDataFrame(DOCS, "doc_id int, text string").select("doc_id", embedding.hash_embedding(F.col("text"), 8).alias("v")).collect()}
    for i, t in DOCS:
        want = [0.0] * 8
        for w in re.findall(r"\w+", (t or "").lower()):
            code = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16
            want[code % 8] += 1 if code >= 8 else -1
        assert got[i] == want


def test_rankings_and_metrics(spark, monkeypatch):
    docs, queries = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(QUERIES, "query_id long, text string")
    words = {i: (t or "").lower().split() for i, t in DOCS}
    full = [w for w in words.values() if w]
    n, mean = len(full), sum(map(len, full)) / len(full)
    want = []
    for q, t in QUERIES:
        scores = defaultdict(int)
        for term in dict.fromkeys(t.split()):
            df = sum(term in w for w in full)
            for i, w in words.items():
                if tf := w.count(term):
                    scores[i] += math.floor(1e6 * math.log(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))))
        want += [(q, i, k, s) for k, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:3], 1)]
    lexical = retrieval.lexical(docs, queries, 3)
    assert sorted(map(tuple, lexical.collect())) == sorted(want)

    monkeypatch.setattr(retrieval, "QUERIES", 2)
    vec = lambda df: df.withColumn("embedding", embedding.hash_embedding(F.col("text"), 16))
    near = retrieval.vectors(vec(docs), vec(queries), 2).collect()
    x = {r.doc_id: np.array(r.embedding) for r in vec(docs).collect()}
    for r in vec(queries).collect():
        q = np.array(r.embedding)
        best = sorted((-float(q @ v) / math.sqrt((q @ q) * (v @ v)), i) for i, v in x.items() if v.any())[:2] if q.any() else []
        assert [(d.doc_id, round(d.score, 12)) for d in sorted(near, key=lambda d: d["rank"]) if d.query_id == r.query_id] == [(i, round(-s, 12)) for s, i in best]

    a, b = (spark.createDataFrame([(1, d, k) for k, d in enumerate(ds, 1)], "query_id long, doc_id long, rank int") for ds in ([5, 6, 7], [7, 5, 8]))
    assert [(r.doc_id, r["rank"]) for r in retrieval.fuse([a, b], 3).orderBy("rank").collect()] == [(5, 1), (7, 2), (6, 3)]
    relevant = spark.createDataFrame([(1, 6, 2), (1, 9, 1), (2, 1, 1)], "query_id long, doc_id long, gain int")
    got = {r.query_id: (r.recall, round(r.ndcg, 9), r["first"]) for r in retrieval.evaluate(a, relevant).collect()}
    assert got == {1: (0.5, round((2 / math.log2(3)) / (2 + 1 / math.log2(3)), 9), 0.5), 2: (0.0, 0.0, 0.0)}


def test_pairs_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    """As many tasks as pairs of queries and documents need, and the same ranking."""
    documents = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 13}" for j in range(9))) for i in range(60)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "w1 w5"), (2, "w2 w3 w7")], "query_id long, text string")
    whole = sorted(map(tuple, retrieval.lexical(documents, queries, 5).collect()))
    monkeypatch.setattr(retrieval, "PAIRS", 8)
    dealt = retrieval.lexical(documents, queries, 5)
    assert "15), REPARTITION_BY_NUM" in dealt._jdf.queryExecution().toString()
    assert sorted(map(tuple, dealt.collect())) == whole and len(whole) == 10

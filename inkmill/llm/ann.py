"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample: the sample is bisected at medians down to equal leaves, then a few
k-means rounds charge full clusters extra. A graph over the centroids is walked in memory by beam search from SEEDS of them, for vectors
and queries alike. Each vector goes to its nearest lists, boundary vectors to several: those within a ratio of the
nearest distance, REPLICAS at most. A query walks to so many of its nearest lists that sampled queries reach RECALL of their
nearest sampled vectors, and of those it reads the ones within another ratio of the nearest distance, the least that
leaves RATIO_RECALL of what was reached. Inner product is turned into distance by one more coordinate, which levels all lengths to the
greatest one.

Equal vectors are one entry of the index with their k + 1 smallest ids; as they tie for every query, no others can be
among its k nearest. Long posting lists, and lists that many queries read, are cut into blocks that meet pairwise,
so no task holds a whole list. A query goes to its lists with a bound: the (k + 1)-th best score among the sampled vectors in its nearest
lists. These are among what it will find, so what scores less can't be an answer and stays behind. Scores are recomputed in double precision on the original vectors.

Vectors that are null, zero or hold a null, NaN or infinite component take no part, as query or as candidate.
Vectors of different lengths have no inner product: each length is searched among itself. A query's own row alone is left out, so rows that
share its vec_id or its vector are found, and rows of queries that share a vec_id are answered each for itself. Ties go to the smaller vec_id. With fewer candidates than k all found come back; an empty table gives an empty table. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SAMPLE, LIST_SIZE, MAX_LISTS = 32_768, 96, 4096
REPLICAS, REPLICA_RATIO = 4, 1.10
#: Share of sampled queries' nearest sampled vectors whose lists the walk must reach, and what share of these the ratio must
#: leave; how many queries are sampled. Neighbours in the whole table are nearer than those in the sample, and found more often.
RECALL, RATIO_RECALL, CALIBRATION = 0.955, 0.99, 512
#: A query's bound is told by the sampled vectors in so many of its nearest lists.
BOUND_LISTS = 16
#: Edges of a centroid, where walks begin, and places that a beam has beyond those asked for.
DEGREE, SEEDS, SPARE = 24, 8, 16
BLOCK, QUERY_BLOCK = 4096, 1024
#: Rows of a distance matrix that are worked out at a time.
ROWS = 1024


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 5, seed: int = 3) -> np.ndarray:
    """Balanced centroids of the rows of x."""
    rng = np.random.default_rng(seed)
    groups = [np.arange(len(x))]
    while len(groups) < lists:
        groups.sort(key=len)
        g = groups.pop()
        if len(g) < 2:
            groups.append(g)
            break
        a, b = x[g[rng.integers(len(g))]], x[g[rng.integers(len(g))]]
        for _ in range(4):
            side = ((x[g] - a) ** 2).sum(1) < ((x[g] - b) ** 2).sum(1)
            if side.all() or not side.any():
                break
            a, b = x[g[side]].mean(0), x[g[~side]].mean(0)
        order = g[np.argsort(x[g] @ (a - b), kind="stable")]
        groups += [order[: len(g) // 2], order[len(g) // 2 :]]
    centroids = np.stack([x[g].mean(0) for g in groups])
    size, target = np.array([len(g) for g in groups], float), len(x) / len(groups)
    for _ in range(rounds):
        charge, spread = 0.02 * np.maximum(size / target - 1, 0), None
        own = np.empty(len(x), np.int64)
        for a in range(0, len(x), ROWS):
            d = squared(x[a : a + ROWS], centroids)
            spread = np.median(d.max(1) - d.min(1)) if spread is None else spread
            own[a : a + ROWS] = (d + spread * charge[None]).argmin(1)
        size = np.bincount(own, minlength=len(centroids)).astype(float)
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centroids)
    return centroids


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a and b."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def build_graph(c: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Neighbour numbers of each centroid: near ones that no nearer chosen one hides, then the nearest left."""
    n = len(c)
    degree = min(degree, max(n - 1, 1))
    out = np.zeros((n, degree), np.int32)
    for a in range(0, n if n > 1 else 0, ROWS):
        far = squared(c[a : a + ROWS], c)
        far[np.arange(len(far)), np.arange(a, a + len(far))] = np.inf
        for i, row in enumerate(far, a):
            near = np.argsort(row, kind="stable")[: min(n - 1, 3 * degree)]
            between = squared(c[near], c[near])
            chosen: list[int] = []
            for j in range(len(near)):
                if len(chosen) < degree // 2 and all(row[near[j]] < between[j, k] for k in chosen):
                    chosen.append(j)
            order = [*chosen, *(j for j in range(len(near)) if j not in set(chosen))]
            out[i] = [*near[order], *[i] * degree][:degree]
    return out


def walk(q: np.ndarray, c: np.ndarray, graph: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search for all rows of q at once: centroid numbers, nearest first, and squared distances."""
    n, beam = len(c), min(beam, len(c))
    norms = (c**2).sum(1)
    own = (q**2).sum(1)[:, None]
    rows = np.arange(len(q))
    entries = np.unique(np.linspace(0, n - 1, min(n, SEEDS)).astype(int))
    dist = own + norms[entries][None] - 2 * q @ c[entries].T
    seen = np.zeros((len(q), n), bool)
    seen[:, entries] = True
    top = np.argsort(dist, axis=1, kind="stable")[:, :beam]
    ids, best = entries[top], np.take_along_axis(dist, top, 1)
    if ids.shape[1] < beam:  # places that the walk fills
        room = ((0, 0), (0, beam - ids.shape[1]))
        ids, best = np.pad(ids, room), np.pad(best, room, constant_values=np.inf)
    done = ~np.isfinite(best)
    while True:
        turn = np.where(done, np.inf, best).argmin(1)
        live = ~done[rows, turn]
        if not live.any():
            return ids, np.maximum(best, 0)
        r = rows[live]
        done[r, turn[live]] = True
        nbr = graph[ids[r, turn[live]]]
        fresh = ~seen[r[:, None], nbr]
        seen[r[:, None], nbr] = True
        d = own[r] + norms[nbr] - 2 * np.einsum("ij,ikj->ik", q[r], c[nbr])
        d[~fresh] = np.inf
        all_d, all_i = np.concatenate([best[r], d], 1), np.concatenate([ids[r], nbr], 1)
        all_done = np.concatenate([done[r], np.zeros(d.shape, bool)], 1)
        keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        best[r], ids[r], done[r] = (np.take_along_axis(a, keep, 1) for a in (all_d, all_i, all_done))
        done |= ~np.isfinite(best)


def near_lists(x: np.ndarray, index: dict, most: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) for every row of x: of its nearest ``most`` lists those within a ratio of the nearest distance."""
    rows, lists = [np.empty(0, int)], [np.empty(0, int)]
    for a in range(0, len(x), ROWS):
        ids, d = walk(x[a : a + ROWS], index["centroids"], index["graph"], most + SPARE)
        ids, d = ids[:, :most], d[:, :most]
        r, k = np.nonzero(np.isfinite(d) & (d <= ratio**2 * d[:, :1] + 1e-12))
        rows.append(r + a)
        lists.append(ids[r, k])
    return np.concatenate(rows), np.concatenate(lists)


def calibrate(x: np.ndarray, dim: int, centroids: np.ndarray, k: int, recall: float = RECALL) -> tuple[int, float]:
    """How many nearest lists a query walks to, and the distance ratio that prunes them. x holds vectors with the levelling coordinate."""
    picked = np.unique(np.linspace(0, len(x) - 1, min(len(x), CALIBRATION)).astype(int))
    queries = np.column_stack([x[picked, :dim], np.zeros(len(picked))])
    to = squared(queries, centroids)
    place = np.argsort(np.argsort(to, axis=1, kind="stable"), axis=1)
    ranks, ratios = [np.zeros(1, int)], [np.ones(1)]
    for a in range(0, len(picked) if len(x) > 1 else 0, 64):
        score = queries[a : a + 64, :dim] @ x[:, :dim].T
        score[np.arange(len(score)), picked[a : a + 64]] = -np.inf
        best = np.argpartition(-score, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
        for row, order, near in zip(to[a : a + 64], place[a : a + 64], best, strict=True):
            d = squared(x[near], centroids)
            own = np.argsort(d, axis=1, kind="stable")[:, :REPLICAS]
            at = np.take_along_axis(d, own, 1)
            rank = np.where(at <= REPLICA_RATIO**2 * at[:, :1], order[own], len(centroids))
            first = rank.argmin(1)
            ranks.append(rank.min(1))
            ratios.append(np.sqrt(row[own[np.arange(len(own)), first]] / max(row.min(), 1e-12)))
    rank, ratio = np.concatenate(ranks), np.concatenate(ratios)
    most = int(np.quantile(rank, recall, method="higher")) + 1
    return most, float(max(np.quantile(ratio[rank < most], RATIO_RECALL), 1.0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def bounds(x: np.ndarray, rows: np.ndarray, lists: np.ndarray, sample: np.ndarray, held: list[np.ndarray], most: int, level: float) -> np.ndarray:
    """For each row of x, the ``most``-th best inner product with the sampled vectors in the first BOUND_LISTS of its lists; -inf if they are fewer.

    (rows, lists) are rows in order, each with its lists, nearest first; held are the numbers of each list's sampled vectors.
    """
    out, ends = np.full(len(x), -np.inf), np.searchsorted(rows, np.arange(len(x) + 1))
    for r in range(len(x)):
        near = np.unique(np.concatenate([held[i] for i in lists[ends[r] : ends[r + 1]][:BOUND_LISTS]] or [np.empty(0, np.int64)]))
        if len(near) >= most:
            # Less what rounding may add.
            out[r] = np.partition(sample[near] @ x[r], len(near) - most)[len(near) - most] - 1e-9 * np.sqrt((x[r] ** 2).sum() * level)
    return out


def _assigned(entries: DataFrame, index, most: int, ratio: float, kept: int = 0) -> DataFrame:
    """entries(vk, vec, ids) once for each of their lists. As queries, with kept, they have bounds; as candidates their lengths are levelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, level = _matrix(b.column(1), index.value["dim"]), index.value["level"]
                last = np.zeros(len(x)) if kept else np.sqrt(np.maximum(level - (x**2).sum(1), 0))
                rows, lists = near_lists(np.column_stack([x, last]), index.value, most, ratio)
                low = bounds(x, rows, lists, index.value["sample"], index.value["held"], kept, level) if kept else np.full(len(x), -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), *(b.column(c).take(pa.array(rows)) for c in range(3)), pa.array(low[rows])], ["list", "vk", "vec", "ids", "low"])

    return entries.select("vk", "vec", "ids").mapInArrow(run, "list int, vk string, vec binary, ids array<long>, low double")


def _keyed(rows: DataFrame) -> DataFrame:
    """(query_id, vk) of rows(vec_id, v)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"query_id": b["vec_id"], "vk": [hashlib.sha256(np.asarray(v, np.float64).tobytes()).hexdigest() for v in b["v"]]})

    return rows.select("vec_id", "v").mapInPandas(run, "query_id long, vk string")


def valid_vector(c: Column) -> Column:
    fine = F.forall(c, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(c.isNotNull() & fine & F.exists(c, lambda x: x != 0), F.lit(False))


def search(embeddings: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest found among embeddings(vec_id, embedding).

    report, if given, gets the numbers of lists and of queries, the lists that these read, the most they may and the ratio.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(valid_vector(F.col("v")) & F.col("vec_id").isNotNull())
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    # A row for each length of vectors; those of one length have an inner product and are searched among themselves.
    shapes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(norm2).alias("level")).orderBy(F.desc("n"), F.desc("dim")).collect()
    if not shapes:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    found = [_search_length(rows.where(F.size("v") == x["dim"]), x["dim"], float(x["level"]), k, recall, report if at == 0 else None) for at, x in enumerate(shapes)]
    return reduce(DataFrame.unionByName, found)


def _search_length(rows: DataFrame, dim: int, level: float, k: int, recall: float, report: dict | None) -> DataFrame:
    """``search`` among rows(vec_id, v, q) whose vectors have dim components and squared norms up to level."""
    spark, kept = rows.sparkSession, k + 1

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row for each different vector of a batch, with its smallest ids."""
        for b in batches:
            if len(b):
                b = pd.DataFrame({"vec": [np.asarray(v, np.float64).tobytes() for v in b["v"]], "id": b["vec_id"], "q": b["q"]}).sort_values("id", kind="stable")
                g = b.groupby("vec", sort=False)
                yield pd.DataFrame({"ids": g["id"].apply(lambda s: sorted(s)[:kept]), "q": g["q"].any()}).reset_index()[["vec", "ids", "q"]]

    small = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, kept)
    entries = rows.mapInPandas(combine, "vec binary, ids array<long>, q boolean").groupBy("vec").agg(small.alias("ids"), F.max("q").alias("q"))
    entries = cut(entries.withColumn("vk", F.sha2("vec", 256)), "vectors")

    n = entries.count()
    sample = entries.orderBy("vk").limit(SAMPLE).select("vec").toArrow()["vec"]
    x = _matrix(sample, dim)
    x = np.concatenate([x, np.sqrt(np.maximum(level - (x**2).sum(1), 0))[:, None]], 1)
    lists = int(min(max(n // LIST_SIZE, 1), MAX_LISTS, max(len(x) // 4, 1)))
    centroids = fit_centroids(x, lists) if len(x) else np.zeros((1, dim + 1))
    most, ratio = calibrate(x, dim, centroids, k, recall) if len(x) else (1, 1.0)
    made = {"centroids": centroids, "graph": build_graph(centroids), "level": level, "dim": dim}
    row, of = near_lists(x, made, REPLICAS, REPLICA_RATIO) if len(x) else (np.empty(0, int), np.empty(0, int))
    order = np.argsort(of, kind="stable")
    made |= {"sample": x[:, :dim], "held": np.split(row[order], np.searchsorted(of[order], np.arange(1, len(centroids))))}
    del x
    index = spark.sparkContext.broadcast(made)  # MAX_LISTS rows and SAMPLE vectors

    postings = cut(_assigned(entries, index, REPLICAS, REPLICA_RATIO), "postings")
    wanted = cut(_assigned(entries.where("q"), index, most, ratio, kept), "wanted")
    if report is not None:
        report |= {"lists": len(centroids), "most": most, "ratio": ratio, "read": wanted.count(), "queries": wanted.select("vk").distinct().count()}

    # Blocks: (list, i, j) holds block i of the list's vectors and block j of its queries.
    size = lambda df, name, per: df.groupBy("list").agg(F.ceil(F.count("*") / per).cast("int").alias(name))
    blocks = F.broadcast(size(postings, "ni", BLOCK).join(size(wanted, "nj", QUERY_BLOCK), "list"))  # MAX_LISTS rows
    part = lambda n: F.pmod(F.xxhash64("vk"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = postings.join(blocks, "list").select("list", part(F.col("ni")).alias("i"), every(F.col("nj")).alias("j"), "vec", "ids")
    right = wanted.join(blocks, "list").select("list", every(F.col("ni")).alias("i"), part(F.col("nj")).alias("j"), "vk", "vec", "low")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Each query of a block with its best ids in the block, those that reach its bound."""
        made: list[tuple[str, float, int, int, bool, int]] = []
        if len(a) and len(b):
            x, q = (np.frombuffer(b"".join(t["vec"]), np.float64).reshape(len(t), -1) for t in (a, b))
            near = q @ x.T
            m = min(len(x), kept + 8)
            ids = a["ids"].to_list()
            first, keys, low = np.array([s[0] for s in ids]), b["vk"].to_list(), b["low"].to_numpy()
            number = [int.from_bytes(hashlib.blake2b(v, digest_size=8).digest(), "little", signed=True) for v in a["vec"]]
            for r in range(len(q)):
                # Every vector that ties with the m-th best stays in.
                cutoff = np.partition(near[r], len(x) - m)[len(x) - m]
                c = np.flatnonzero(near[r] >= max(cutoff - 1e-9 * abs(cutoff), low[r]))
                exact = (x[c] * q[r]).sum(1)
                order = np.lexsort((first[c], -exact))[:kept]
                # A row is told by its id, which row of that id and vector it is, and its vector.
                pairs = sorted((-exact[o], i, int(at - np.searchsorted(own, i)), bool((x[c[o]] == q[r]).all()), number[c[o]]) for o in order for own in (ids[c[o]],) for at, i in enumerate(own))[:kept]
                made += [(keys[r], *p) for p in pairs]
        return pd.DataFrame(made, columns=["vk", "minus", "id", "nth", "same", "vec"]).astype({"minus": float, "id": np.int64, "nth": np.int64, "same": bool, "vec": np.int64})

    found = left.groupBy("list", "i", "j").cogroup(right.groupBy("list", "i", "j")).applyInPandas(meet, "vk string, minus double, id long, nth long, same boolean, vec long")
    best = found.groupBy("vk").agg(F.slice(F.sort_array(F.collect_set(F.struct("minus", "id", "nth", "same", "vec"))), 1, kept).alias("found"))
    answers = _keyed(rows.where("q")).join(best, "vk")
    # The query's own row alone is no answer; other rows may have its id, or its vector.
    others = F.slice(F.filter("found", lambda x: ~((x["id"] == F.col("query_id")) & x["same"] & (x["nth"] == 0))), 1, k)
    score = F.when(F.col("x.minus") == 0, 0.0).otherwise(-F.col("x.minus"))
    return answers.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), score.alias("score"))

"""Boxes that meet against all pairs; a page of very many boxes."""

import random

from pyspark.sql import functions as F

from inkmill.operators import blocks, geometry


def boxes(seed, n, most, pages=3):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, y = rng.uniform(-50, 1000), rng.uniform(0, 1400)
        out.append((rng.randrange(pages), k, [x, y, x + rng.choice([0, 5, most]), y + rng.uniform(0, most)]))
    return out


def test_meeting_is_all_pairs_that_touch(spark):
    a, b = boxes(1, 300, 80), boxes(2, 60, 400)
    a += [(0, 900, None), (0, 901, [1.0]), (0, 902, [None, 1.0, 2.0, 3.0]), (7, 903, [0.0, 0.0, 1.0, 1.0]), (0, 904, [-1e6, -1e6, 1e6, 1e6])]
    left, right = spark.createDataFrame(a, "page int, a int, bbox array<double>"), spark.createDataFrame(b, "page int, b int, bbox array<double>")
    for sx, sy in ((0, 0), (100, 40)):
        got = [(r.page, r.a, r.b) for r in geometry.meeting(left, right, ["page"], sx, sy).collect()]
        want = sorted((p, i, j) for p, i, x in a if x and len(x) == 4 and None not in x for q, j, y in b if p == q and x[0] <= y[2] + sx and x[2] >= y[0] - sx and x[1] <= y[3] + sy and x[3] >= y[1] - sy)
        assert sorted(got) == want
    assert geometry.meeting(left, right.where("false"), ["page"]).count() == 0


def test_a_crowded_page(spark):
    """A hundred thousand lines and some thousand tables on one page: lines meet the tables of their cells, not all of them."""
    n = 100_000
    at = lambda c, m: (F.col("id") * c % m).cast("double")
    lines = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), "id", F.array(at(7919, 10_000), at(104_729, 14_000), at(7919, 10_000) + 30, at(104_729, 14_000) + 8).alias("bbox"))
    tables = spark.range(2_000).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.array(at(6101, 10_000), at(9973, 14_000), at(6101, 10_000) + 120, at(9973, 14_000) + 60).alias("bbox"))
    met = geometry.meeting(lines, tables, ["doc_id", "page"])
    assert met.count() < 100 * n
    kept = {r.id for r in blocks.outside_tables(lines, tables).collect()}
    import numpy as np

    i, k = np.arange(n), np.arange(2_000)
    x, y, tx, ty = i * 7919 % 10_000, i * 104_729 % 14_000, k * 6101 % 10_000, k * 9973 % 14_000
    inside = np.zeros(n, bool)
    for a, b in zip(tx, ty, strict=True):
        inside |= (x >= a - 2) & (y >= b - 2) & (x + 30 <= a + 122) & (y + 8 <= b + 62)
    assert kept == set(np.flatnonzero(~inside).tolist())

"""Cleaning by quartiles of groups, and change detection by ranges."""

import random

from pyspark.sql import functions as F

from inkmill.operators import checks, cleaning


def test_clean(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice("abc"), rng.gauss(0, 1) if k % 9 else None, f" x　{k} \t y ") for k in range(900)] + [(1000, "a", 1e6, None), (1001, None, 5.0, " "), (1002, None, None, "z"), (1003, "d", None, "z")]
    df = spark.createDataFrame(rows, "id int, g string, v double, t string")
    got = {r.id: r for r in cleaning.clean(df, "g", ["v"], ["t"]).collect()}
    values = {}
    for _, g, v, _ in rows:
        if v is not None:
            values.setdefault(g, []).append(v)
    q = {g: [sorted(v)[-(-len(v) * k // 4) - 1] for k in (1, 2, 3)] for g, v in values.items()}
    for i, g, v, t in rows:
        lower, middle, upper = q.get(g, (None, None, None))
        assert got[i].v == (v if v is not None else middle) and got[i].filled == (["v"] if v is None and middle is not None else [])
        assert got[i].outliers == (["v"] if v is not None and not lower - 1.5 * (upper - lower) <= v <= upper + 1.5 * (upper - lower) else [])
    assert got[5].t == "x 5 y" and got[1001].t is None and len(got) == len(rows)
    wide = spark.range(200_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    for r in cleaning.quantiles(wide, "g", ["v"], 1000).collect():
        for name, share in (("lower", 0.25), ("middle", 0.5), ("upper", 0.75)):
            assert abs(wide.where((F.col("g") == r.g) & (F.col("v") <= r.v[name])).count() / r.n - share) <= 1 / 1000 + 1e-4


def test_changes_by_ranges(spark):
    old = spark.range(-500, 20_000).select("id", (F.col("id") * 3).alias("v"), F.when(F.col("id") % 7 == 0, None).otherwise(F.lit("s")).alias("s"))
    new = old.where("id NOT IN (3, 4095, 4096)").withColumn("v", F.when(F.col("id").isin(-499, 70, 19_999), 1).otherwise(F.col("v"))).withColumn("s", F.when(F.col("id") == 77, "t").otherwise(F.col("s"))).unionByName(spark.createDataFrame([(50_000, 1, "n"), (-9_000, 1, "n")], "id long, v long, s string"))
    got = sorted(map(tuple, checks.changes_by_ranges(old, new, "id").collect()))
    assert got == sorted(map(tuple, checks.sync_changes(old, new, "id").collect())) == sorted([(3, "removed"), (4095, "removed"), (4096, "removed"), (-499, "changed"), (70, "changed"), (19_999, "changed"), (77, "changed"), (50_000, "added"), (-9_000, "added")])
    parts = checks.differing(checks.digests(old, "id", 4096), checks.digests(new, "id", 4096))
    assert old.join(parts, F.floor(F.col("id") / 4096) == F.col("part"), "left_semi").count() < old.count()
    fine = checks.differing(checks.digests(old, "id", 4), checks.digests(new, "id", 4))
    assert old.join(fine, F.floor(F.col("id") / 4) == F.col("part"), "left_semi").count() < 0.01 * old.count()
    assert checks.changes_by_ranges(old, old, "id").count() == 0

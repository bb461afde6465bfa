"""Keys and inclusions against every combination and pair."""

from itertools import combinations

from pyspark.sql import functions as F

from inkmill.operators import structure


def test_minimal_keys(spark):
    rows = [(k, k % 7, k // 7, None if k == 3 else k, "x", [k]) for k in range(70)]
    df = spark.createDataFrame(rows, "id long, a int, `b.c` int, holed int, same string, listed array<int>")
    assert structure.minimal_keys(df) == [("id",), ("a", "b.c")]
    assert structure.minimal_keys(df.unionByName(df.limit(1))) == []
    assert structure.minimal_keys(df.drop("id"), 1) == []


def test_foreign_keys(spark, sf):
    names = ["region", "nation", "customer", "supplier", "orders"]
    tables = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in names}
    got = {(r.table_name, r.column, r.ref_table, r.ref_column): r for r in structure.foreign_keys(spark, tables).collect()}
    assert {k for k, r in got.items() if r.named} == {("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey")}
    values = {(t, c): {r[0] for r in df.select(c).distinct().collect()} for t, df in tables.items() for c, kind in df.dtypes if kind in ("int", "bigint")}
    want = {(*a, *b) for a in values for b in values if a != b and values[a] <= values[b]}
    assert {(r.table_name, r.column, r.ref_table, r.ref_column) for r in structure.inclusions(tables).collect()} == want
    keys = {(r.table_name, r.key) for r in structure.table_keys(spark, {"nation": tables["nation"]}).collect()}
    data = [tuple(r) for r in tables["nation"].collect()]
    columns, minimal = tables["nation"].columns, set()
    for size in (1, 2):
        for s in combinations(range(len(columns)), size):
            if len({tuple(r[k] for k in s) for r in data}) == len(data) and not any(set(m) <= set(s) for m in minimal):
                minimal.add(s)
    assert keys == {("nation", ",".join(columns[k] for k in s)) for s in minimal}


def test_values_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    """As many tasks as rows need; the same inclusions whether values are sent once or as they stand."""
    tables = {"a": spark.range(100).select(F.col("id").alias("a_id")), "b": spark.range(300).select((F.col("id") % 50).alias("b_a_id"))}
    whole = sorted(map(tuple, structure.inclusions(tables).collect()))
    monkeypatch.setattr(structure, "GROUPED", 20)
    dealt = structure.inclusions(tables)
    assert "20), REPARTITION_BY_NUM" in dealt._jdf.queryExecution().toString()
    assert sorted(map(tuple, dealt.collect())) == whole == [("b", "b_a_id", "a", "a_id", 0.5)]
    assert structure.minimal_keys(tables["a"]) == [("a_id",)]

"""What a set of tables tells of itself: minimal keys, and columns whose values all stand in another column."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sketches are this exact; a combination whose sketch is below SURE of the rows is no key.
ERROR, SURE = 0.02, 0.9
#: Rows that a task groups at most, and different values that are told apart before rows are dealt; memory of a task doesn't grow with the tables.
GROUPED = 1 << 20
#: Column sets are bits of one long.
MOST_COLUMNS = 62


def _quoted(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def _dealt(df: DataFrame, rows: int, *by: Column) -> DataFrame:
    """df by its values in as many parts as keep GROUPED rows each, however many cores there are."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // GROUPED)), *by)


def _repeats(df: DataFrame, columns: tuple[str, ...], n: int) -> bool:
    """Whether two of n rows share their values of columns, which are known to be near as many as rows."""
    return not _dealt(df.select(*map(_quoted, columns)), n, *map(_quoted, columns)).groupBy(*map(_quoted, columns)).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def minimal_keys(df: DataFrame, most: int = 2) -> list[tuple[str, ...]]:
    """The smallest sets of at most ``most`` columns that no two rows share and that hold no null, level by level.

    One pass sketches all of a level's sets; only those whose sketch comes near the number of rows are grouped. A set that holds a key isn't looked at,
    nor one whose columns' numbers of values can't make as many rows.
    """
    columns = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant", "array")]
    sketch = lambda cs: F.approx_count_distinct(F.xxhash64(*map(_quoted, cs)), ERROR)
    first = df.agg(F.count("*"), *(sketch([c]) for c in columns), *(F.count(_quoted(c)) for c in columns)).first()
    n, values = first[0], dict(zip(columns, first[1 : 1 + len(columns)], strict=True))
    whole = [c for c, k in zip(columns, first[1 + len(columns) :], strict=True) if k == n]
    keys: list[tuple[str, ...]] = []
    for size in range(1, most + 1):
        sets = [s for s in combinations(whole, size) if not any(set(k) <= set(s) for k in keys) and reduce(lambda a, c: a * values[c] / SURE, s, 1.0) >= n]
        if size > 1 and sets:
            near = df.agg(*(sketch(s).alias(str(k)) for k, s in enumerate(sets))).first()
            sets = [s for k, s in enumerate(sets) if near[k] >= SURE * n]
        keys += [s for s in sets if not _repeats(df, s, n)]
    return keys


def table_keys(spark: SparkSession, tables: dict[str, DataFrame], most: int = 2) -> DataFrame:
    """(table_name, key): the minimal keys of every table, their columns joined by commas."""
    found = [(name, ",".join(key)) for name, df in tables.items() for key in minimal_keys(df, most)]
    return spark.createDataFrame(found, "table_name string, key string")


def inclusions(tables: dict[str, DataFrame], kinds: tuple[str, ...] = ("integer", "long", "short", "byte")) -> DataFrame:
    """(table_name, column, ref_table, ref_column, share): columns whose values all stand in the other; share is how many of its values they are.

    Every column's values are dealt out once by value: a value's columns are the bits of a long, and a column is included in those whose
    bit is set with all of its values. Columns of few values send each but once. Bounds and sketches leave out columns beforehand that can't be part of any pair. Nulls are no values.
    """
    columns = [(t, f.name) for t, df in tables.items() for f in df.schema if f.dataType.typeName() in kinds]
    if not columns or len(columns) > MOST_COLUMNS:
        raise ValueError(f"1 to {MOST_COLUMNS} columns can be compared at once, not {len(columns)}")
    spark = next(iter(tables.values())).sparkSession
    shape, rows = {}, {}
    for t, df in tables.items():
        own = [c for x, c in columns if x == t]
        if own:
            row = df.agg(F.count("*"), *(f(_quoted(c)) for c in own for f in (F.min, F.max, lambda x: F.approx_count_distinct(x, ERROR)))).first()
            shape |= {(t, c): row[3 * k + 1 : 3 * k + 4] for k, c in enumerate(own)}
            rows |= {(t, c): row[0] for c in own}
    fits = lambda a, b: shape[a][0] is not None and shape[b][0] is not None and shape[a][0] >= shape[b][0] and shape[a][1] <= shape[b][1] and SURE * shape[a][2] <= shape[b][2] / SURE
    pairs = {(a, b) for a in columns for b in columns if a != b and fits(a, b)}
    used = [c for c in columns if any(c in p for p in pairs)]
    if not pairs:
        return spark.createDataFrame([], "table_name string, column string, ref_table string, ref_column string, share double")
    one = F.lit(1).cast("long")
    few = {c for c in used if shape[c][2] <= GROUPED}
    sent = lambda df, c: df.distinct() if c in few else df
    each = [sent(tables[c[0]].select(_quoted(c[1]).cast("long").alias("value"), F.lit(k).alias("k")).where("value IS NOT NULL"), c) for k, c in enumerate(used)]
    total = sum(shape[c][2] if c in few else rows[c] for c in used)
    masks = _dealt(reduce(DataFrame.unionByName, each), total, F.col("value")).groupBy("value").agg(F.bit_or(F.call_function("shiftleft", one, F.col("k"))).alias("mask"))
    held = F.filter(F.array(*map(F.lit, range(len(used)))), lambda k: F.call_function("getbit", F.col("mask"), k) == 1)
    per = masks.select("mask", F.explode(held).alias("k")).groupBy("k").agg(F.bit_and("mask").alias("mask"), F.count("*").alias("n"))
    names = spark.createDataFrame([(k, t, c) for k, (t, c) in enumerate(used)], "k int, t string, c string")  # MOST_COLUMNS rows
    refs = per.select("k", "n", F.explode(F.filter(F.array(*map(F.lit, range(len(used)))), lambda r: (F.call_function("getbit", F.col("mask"), r) == 1) & (r != F.col("k")))).alias("ref"))
    sizes = per.select(F.col("k").alias("ref"), F.col("n").alias("ref_n"))
    small = refs.join(F.broadcast(sizes), "ref")  # MOST_COLUMNS rows
    small = small.join(F.broadcast(names.toDF("k", "table_name", "column")), "k").join(F.broadcast(names.toDF("ref", "ref_table", "ref_column")), "ref")
    return small.select("table_name", "column", "ref_table", "ref_column", (F.col("n") / F.col("ref_n")).alias("share"))


def foreign_keys(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``inclusions`` in another table's single-column key, with named: whether both columns have the same name behind their tables' prefix."""
    keys = {(r["table_name"], r["key"]) for r in table_keys(spark, tables, 1).collect()}  # a table has at most as many as columns
    keyed = spark.createDataFrame(sorted(keys), "ref_table string, ref_column string")
    tail = lambda c: F.regexp_replace(c, "^[^_]*_", "")
    found = inclusions(tables).where("table_name <> ref_table").join(F.broadcast(keyed), ["ref_table", "ref_column"])
    return found.select("table_name", "column", "ref_table", "ref_column", "share", (tail(F.col("column")) == tail(F.col("ref_column"))).alias("named"))

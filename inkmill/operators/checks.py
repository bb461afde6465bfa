"""Table checks: completeness and uniqueness of columns, what changed between two copies, volumes by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_report(rows: DataFrame, error: float = 0.02, exact: list[str] | None = None) -> DataFrame:
    """(column, n_rows, n_null, n_distinct) of every column, from one pass.

    n_distinct is an estimate with that relative standard error; the columns named in exact are counted, each by a pass of its own.
    """
    found = [F.count("*").alias("n")]
    for k, c in enumerate(rows.columns):
        found += [F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"null_{k}"), F.approx_count_distinct(f"`{c}`", error).alias(f"distinct_{k}")]
    one = rows.agg(*found)
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(f"null_{k}").alias("n_null"), F.col(f"distinct_{k}").alias("n_distinct")) for k, c in enumerate(rows.columns)))
    out = one.select(F.inline(each))
    for c in exact or ():
        n = rows.select(f"`{c}`").distinct().agg(F.count(f"`{c}`").alias("_n"))
        out = out.join(F.broadcast(n.withColumn("_c", F.lit(c))), F.col("column") == F.col("_c"), "left").select("column", "n_rows", "n_null", F.coalesce("_n", "n_distinct").alias("n_distinct"))
    return out


def sync_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or changed rows between two copies of a table, by a hash of the other columns."""
    others = [c for c in new.columns if c != key]
    a = old.select(key, F.xxhash64(*others).alias("was"))
    b = new.select(key, F.xxhash64(*others).alias("now"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def digests(rows: DataFrame, key: str, width: int) -> DataFrame:
    """(part, n, digest): a digest of all rows of each range of ``width`` keys, whatever their order. Kept beside a copy, it stands for the copy's rows."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(F.floor(F.col(key) / width).alias("part")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(key, F.xxhash64(*others), F.lit(1))).alias("digest"))


def differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """(part): ranges whose digests differ, or that one side lacks."""
    a, b = (d.select("part", F.struct("n", "digest").alias(x)) for d, x in ((old, "was"), (new, "now")))
    return a.join(b, "part", "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select("part")


def changes_by_ranges(old: DataFrame, new: DataFrame, key: str, widths: tuple[int, ...] = (4096, 64, 4)) -> DataFrame:
    """``sync_changes`` by a tree of digests: only rows of ranges that differ at one width are looked at with the next, and few meet each other.

    Keys are whole numbers, each once.
    """
    for width in widths:
        parts = differing(digests(old, key, width), digests(new, key, width))
        n = parts.count()
        parts = F.broadcast(parts) if n <= 500_000 else parts
        old, new = (t.join(parts, F.floor(F.col(key) / width) == F.col("part"), "left_semi") for t in (old, new))
    return sync_changes(old, new, key)

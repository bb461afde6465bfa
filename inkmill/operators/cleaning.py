"""Cleaning of tables: texts brought to one form, gaps filled and outliers told by bounds of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: A quantile's rank is off by at most one in so many rows of its group.
ACCURACY = 10_000
BROADCAST_GROUPS = 200_000


def quantiles(rows: DataFrame, group: str, columns: list[str], accuracy: int = ACCURACY) -> DataFrame:
    """(group, n, and for each column lower, middle and upper quartile as a struct) by sketches that tasks make and Spark merges, in one pass."""
    quarter = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], accuracy)
    found = rows.groupBy(group).agg(F.count("*").alias("n"), *(quarter(c).alias(f"_{c}") for c in columns))
    return found.select(group, "n", *(F.struct(*(F.get(f"_{c}", F.lit(k)).alias(n) for k, n in enumerate(("lower", "middle", "upper")))).alias(c) for c in columns))


def standard(text: Column, upper: bool = False) -> Column:
    """A text without white space around it and with single blanks within; null if nothing is left."""
    one = F.regexp_replace(strip(text), F.lit(r"(?U)\s+"), F.lit(" "))
    return F.nullif(F.upper(one) if upper else one, F.lit(""))


def clean(rows: DataFrame, group: str, columns: list[str], texts: list[str] = (), reach: float = 1.5, accuracy: int = ACCURACY) -> DataFrame:
    """rows with texts in standard form, gaps in columns filled with their group's median, and filled and outliers: the names of such columns.

    A value is an outlier if it is beyond ``reach`` times the distance of the quartiles below the lower or above the upper one. A group
    without values keeps its gaps. Rows of a null group are a group of their own.
    """
    bounds = quantiles(rows, group, columns, accuracy).select(F.col(group).alias("_group"), F.struct(*columns).alias("_q"))
    bounds = F.broadcast(bounds) if bounds.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else bounds
    both = rows.join(bounds, rows[group].eqNullSafe(bounds["_group"]), "left")
    q = lambda c, n: F.col(f"_q.{c}.{n}")
    gap = lambda c: F.col(c).isNull() & q(c, "middle").isNotNull()
    far = lambda c: (F.col(c) < q(c, "lower") - reach * (q(c, "upper") - q(c, "lower"))) | (F.col(c) > q(c, "upper") + reach * (q(c, "upper") - q(c, "lower")))
    named = lambda test: F.array_compact(F.array(*(F.when(F.coalesce(test(c), F.lit(False)), F.lit(c)) for c in columns)))
    shown = [F.coalesce(c, q(c, "middle")).alias(c) if c in columns else standard(F.col(c)).alias(c) if c in texts else F.col(c) for c in rows.columns]
    return both.select(*shown, named(gap).alias("filled"), named(far).alias("outliers"))

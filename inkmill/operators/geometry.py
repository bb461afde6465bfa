"""Boxes that meet, by cells of a grid instead of all pairs of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells along each side of a page at most; a page of few boxes has few, as many as it has boxes in all.
CELLS = 256


def _corner(box: Column, k: int) -> Column:
    return F.get(box, F.lit(k)).cast("double")


def _covered(low: Column, high: Column, origin: Column, step: Column) -> Column:
    """Numbers of the cells from low to high, within the page's _n."""
    cell = lambda v: F.least(F.greatest(F.floor((v - origin) / step), F.lit(0)), F.col("_n") - 1).cast("int")
    return F.sequence(cell(low), F.greatest(cell(low), cell(high)))


def meeting(left: DataFrame, right: DataFrame, keys: list[str], slack_x: float = 0.0, slack_y: float = 0.0, box: str = "bbox") -> DataFrame:
    """Pairs (keys, left's other columns, right's) whose boxes overlap or touch, right's being widened by the slacks.

    Each page (keys) has a grid over right's boxes. A box is dealt to the cells that it covers and meets only boxes
    of its cells; a pair is kept in the one cell that holds the first corner of what both share. Columns of both sides must have different
    names but for the keys; boxes without four numbers meet nothing.
    """
    l_box, r_box = F.col(box), F.col(f"right_{box}")
    full = lambda b: b.isNotNull() & (F.size(b) == 4) & F.forall(b, lambda x: x.isNotNull())
    right = right.withColumnRenamed(box, f"right_{box}").where(full(r_box))
    edges = [_corner(r_box, 0) - slack_x, _corner(r_box, 1) - slack_y, _corner(r_box, 2) + slack_x, _corner(r_box, 3) + slack_y]
    right = right.withColumn("_r", F.array(*edges))
    r = [F.get("_r", F.lit(k)) for k in range(4)]
    grid = right.groupBy(*keys).agg(F.min(r[0]).alias("_x"), F.min(r[1]).alias("_y"), F.max(r[2]).alias("_xx"), F.max(r[3]).alias("_yy"), F.least(F.ceil(F.sqrt(F.count("*"))), F.lit(CELLS)).alias("_n"))
    step = lambda low, high: F.greatest((F.col(high) - F.col(low)) / F.col("_n"), F.lit(1e-6))
    grid = grid.select(*keys, "_n", "_x", "_y", step("_x", "_xx").alias("_dx"), step("_y", "_yy").alias("_dy"), "_xx", "_yy")
    cells = lambda b: (_covered(b[0], b[2], F.col("_x"), F.col("_dx")), _covered(b[1], b[3], F.col("_y"), F.col("_dy")))

    def dealt(rows: DataFrame, b: list[Column]) -> DataFrame:
        across, down = cells(b)
        return rows.withColumn("_cx", F.explode(across)).withColumn("_cy", F.explode(down))

    r_rows = dealt(right.join(grid, keys), r).drop("_n", "_x", "_y", "_dx", "_dy", "_xx", "_yy")
    lb = [_corner(l_box, k) for k in range(4)]
    near = left.where(full(l_box)).join(grid, keys)
    # A box beside all of right's meets none of them.
    near = near.where((lb[0] <= F.col("_xx")) & (lb[2] >= F.col("_x")) & (lb[1] <= F.col("_yy")) & (lb[3] >= F.col("_y")))
    both = dealt(near, lb).join(r_rows, [*keys, "_cx", "_cy"])
    touch = (lb[0] <= r[2]) & (lb[2] >= r[0]) & (lb[1] <= r[3]) & (lb[3] >= r[1])
    first = lambda k, origin, size: F.least(F.greatest(F.floor((F.greatest(lb[k], r[k]) - F.col(origin)) / F.col(size)), F.lit(0)), F.col("_n") - 1).cast("int")
    both = both.where(touch & (first(0, "_x", "_dx") == F.col("_cx")) & (first(1, "_y", "_dy") == F.col("_cy")))
    return both.drop("_n", "_x", "_y", "_dx", "_dy", "_xx", "_yy", "_cx", "_cy", "_r")

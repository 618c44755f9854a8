"""Operators on grid cells: neighbourhood means and inverse-distance weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import checkpoint


def neighbourhood_mean(cells: DataFrame, by: list[str], reach: int = 1) -> DataFrame:
    """(by, x, y, mean, n) of cells (by, x, y, value, variance): inverse-variance mean of the cells within reach.

    Every cell is sent to its neighbours and summed there, only where a cell exists: one
    partial aggregate and one semi join, and no window of cells in a task.
    """
    span = range(-reach, reach + 1)
    shifts = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in span for j in span)))
    sent = cells.withColumn("s", shifts).select(*by, (F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"), "value", "variance")
    sums = sent.groupBy(*by, "x", "y").agg((F.sum(F.col("value") / F.col("variance")) / F.sum(1 / F.col("variance"))).alias("mean"), F.count(F.lit(1)).alias("n"))
    return sums.join(cells.select(*by, "x", "y").distinct(), [*by, "x", "y"], "left_semi")


def inverse_distance(anchors: DataFrame, by: list[str], columns: int, rows: int, cell: float, floor: float = 1.0) -> DataFrame:
    """(by, gx, gy, value, nearest): a grid over each group's anchors (by, x, y, value), weighted by distance^-4.

    Every anchor adds to every node of its group's grid, which has a fixed size.
    """
    nodes = F.explode(F.array(*(F.struct(F.lit(i).alias("gx"), F.lit(j).alias("gy")) for i in range(columns) for j in range(rows))))
    pairs = anchors.withColumn("g", nodes).select(*by, "g.gx", "g.gy", "x", "y", "value")
    dx, dy = F.col("x") - (F.col("gx") + 0.5) * cell, F.col("y") - (F.col("gy") + 0.5) * cell
    pairs = pairs.withColumn("d2", F.greatest(dx * dx + dy * dy, F.lit(floor)))
    weight = 1 / (F.col("d2") * F.col("d2"))
    return pairs.groupBy(*by, "gx", "gy").agg((F.sum(weight * F.col("value")) / F.sum(weight)).alias("value"), F.sqrt(F.min("d2")).alias("nearest"))


def sample_field(points: DataFrame, field: DataFrame, by: list[str], columns: int, rows: int, cell: float) -> DataFrame:
    """points (by, x, y, ...) with dx and dy, bilinear between the four cells of field (by, cx, cy, dx, dy) around them.

    A cell's value is that of its centre, pixels being numbered by their centres; beyond the
    outermost centres the border's value holds. Points go to their four cells by a join on
    the cell, and their shares are summed. A point with a missing cell has nulls.
    """
    half = 0.5 * (cell - 1)
    own = points.withColumn("_at", F.monotonically_increasing_id())
    place = lambda c, n: F.least(F.greatest((F.col(c) - half) / cell, F.lit(0.0)), F.lit(float(n - 1)))
    own = checkpoint(own.withColumn("_gx", place("x", columns)).withColumn("_gy", place("y", rows)))
    corners = [F.struct(F.least(F.floor("_gx") + i, F.lit(columns - 1)).cast("long").alias("cx"), F.least(F.floor("_gy") + j, F.lit(rows - 1)).cast("long").alias("cy"), ((F.col("_gx") - F.floor("_gx") if i else 1 - F.col("_gx") + F.floor("_gx")) * (F.col("_gy") - F.floor("_gy") if j else 1 - F.col("_gy") + F.floor("_gy"))).alias("w")) for i in (0, 1) for j in (0, 1)]
    sent = own.select("_at", *by, F.explode(F.array(*corners)).alias("c")).select("_at", *by, "c.*")
    met = sent.join(field.select(*by, "cx", "cy", "dx", "dy"), [*by, "cx", "cy"])
    sums = met.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("w") * F.col("dx")).alias("dx"), F.sum(F.col("w") * F.col("dy")).alias("dy")).where("_n = 4").drop("_n")
    return own.join(sums, "_at", "left").drop("_at", "_gx", "_gy")

"""Positions of rows within their group, in order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import checkpoint


def positions(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with position, from 0, and size, the group's number of rows; written once, so equal keys keep their positions.

    Rows are ranged over partitions by group and order, numbered in each and offset by what the
    partitions before hold of the group, so no task sees a whole group, however large.
    """
    ranged = checkpoint(df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))
    keys = [f"_k{i}" for i in range(len(by))]
    parts = ranged.groupBy(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.col("_p").alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    parts = parts.withColumn("_before", F.sum("_n").over(group.orderBy("_q")) - F.col("_n")).withColumn("size", F.sum("_n").over(group)).drop("_n")
    same = [F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys, strict=True)]
    placed = ranged.join(parts, [F.col("_p") == F.col("_q"), *same])
    own = F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order)) - 1
    return checkpoint(placed.withColumn("position", own + F.col("_before")).select(*df.columns, "position", "size"))

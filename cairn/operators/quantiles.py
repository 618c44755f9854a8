"""Exact quantiles of groups of any size, from counts of equal values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import checkpoint


def quantiles(df: DataFrame, by: list[str], value: str, shares: tuple[float, ...], nearest: tuple[float, ...] = ()) -> DataFrame:
    """(by, n, q0, q1, ..., r0, r1, ...): linear quantiles for ``shares``, values at the nearest rank for ``nearest``.

    Equal values are counted first. The different values are then ranged over partitions,
    counted up within each and offset by what the partitions before hold of the group, so no
    task sees a whole group, however large. Null values are left out, and groups without
    others with them; null keys are a group.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.col(value).cast("double").alias("_v")).where("_v is not null")
    rows = rows.withColumn("_g", F.xxhash64(F.lit(0), *keys))
    counts = checkpoint(rows.groupBy("_g", *keys, "_v").agg(F.count(F.lit(1)).alias("_n")).repartitionByRange("_g", "_v").withColumn("_p", F.spark_partition_id()))
    parts = counts.groupBy("_g", *keys, "_p").agg(F.sum("_n").alias("_part"))
    of_group = Window.partitionBy("_g", *keys)
    parts = parts.withColumn("_before", F.sum("_part").over(of_group.orderBy("_p")) - F.col("_part")).withColumn("_all", F.sum("_part").over(of_group)).drop("_part")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    placed = counts.alias("a").join(parts.alias("b"), [F.col("a._g") == F.col("b._g"), F.col("a._p") == F.col("b._p"), *same]).select("a.*", "_before", "_all")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("_g", *keys, "_p").orderBy("_v"))
    placed = placed.withColumn("_upto", upto)
    at = lambda rank: F.max(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col("_v")))
    wanted = []
    for i, share in enumerate(shares):
        wanted += [at(F.floor((F.col("_all") - 1) * share)).alias(f"_lo{i}"), at(F.ceil((F.col("_all") - 1) * share)).alias(f"_hi{i}")]
    wanted += [at(F.floor((F.col("_all") - 1) * share + 0.5)).alias(f"r{i}") for i, share in enumerate(nearest)]
    found = placed.groupBy(*keys).agg(F.max("_all").alias("n"), *wanted).where("n is not null")  # no keys and no rows leave an empty sum
    between = lambda i, share: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * ((F.col("n") - 1) * share - F.floor((F.col("n") - 1) * share))
    return found.select(*(F.col(k).alias(b) for k, b in zip(keys, by, strict=True)), "n", *(between(i, s).alias(f"q{i}") for i, s in enumerate(shares)), *(f"r{i}" for i in range(len(nearest))))

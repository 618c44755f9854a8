"""As-of joins by time buckets, so that no key's rows need to fit a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, tolerance: float, right_columns: list[str]) -> DataFrame:
    """Each left row with the right row nearest in time within tolerance (ties to the earlier, then the smaller columns); rows without one are left out.

    left needs a unique column _row. Bucket size is the tolerance, so a match is in the
    bucket itself or next to it.
    """
    carried = [F.col(c).alias(f"_right_{c}") for c in right_columns]
    names = [f"_right_{c}" for c in right_columns]
    a = left.withColumn("_b", F.floor(F.col(left_time) / tolerance))
    b = right.select(*by, F.col(right_time).alias("_t"), *carried).withColumn("_s", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("_b", F.floor(F.col("_t") / tolerance) + F.col("_s"))
    close = a.join(b.drop("_s"), [*by, "_b"]).withColumn("_gap", F.abs(F.col("_t") - F.col(left_time))).where(F.col("_gap") <= tolerance)
    best = close.groupBy("_row").agg(F.min(F.struct("_gap", "_t", *names)).alias("_m"))
    return left.join(best, "_row").select(*left.columns, F.col("_m._t").alias("right_time"), *(F.col(f"_m.{n}").alias(n[1:]) for n in names))


def forward(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, right_columns: list[str], clamp: bool = True, bucket: float = 86_400.0) -> DataFrame:
    """Each left row with the first right row at or after it; past the end the last one if clamp.

    Within a bucket of time both sides are sorted together and the next right row is the
    first non-null ahead; past the bucket's end it is the first of the next bucket that has
    one, found among one row per bucket. So a key with very many rows is cut by time.
    """
    value = F.struct(F.col("_t"), *right_columns)
    b = right.select(*by, F.col(right_time).alias("_t"), *right_columns).withColumn("_value", value).select(*by, "_t", F.lit(1).alias("_side"), "_value")
    a = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(0)).withColumn("_value", F.lit(None).cast(b.schema["_value"].dataType))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_t") / bucket))
    buckets = both.groupBy(*by, "_b").agg(F.min("_value").alias("_first"), F.max("_value").alias("_last"))
    order = Window.partitionBy(*by).orderBy("_b")
    later = F.first("_first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    latest = F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    buckets = buckets.select(*by, "_b", later.alias("_later"), latest.alias("_latest"))
    ahead = Window.partitionBy(*by, "_b").orderBy("_t", "_side", "_value").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = both.withColumn("_m", F.first("_value", ignorenulls=True).over(ahead)).where("_side = 0").join(buckets, [*by, "_b"])
    picked = F.coalesce("_m", "_later", "_latest") if clamp else F.coalesce("_m", "_later")
    return found.withColumn("_m", picked).select(*left.columns, F.col("_m._t").alias("right_time"), *(F.col(f"_m.{c}").alias(f"right_{c}") for c in right_columns))


def gaps_and_islands(df: DataFrame, by: list[str], order: list[str], broken) -> DataFrame:
    """df with island: how many breaks lie at or before the row, in order, within by."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("island", F.sum(broken.cast("long")).over(w))


def sessions(df: DataFrame, by: list[str], time: str, gap: float, tie: str) -> DataFrame:
    """df with session: rows split where the time since the row before exceeds gap."""
    before = F.lag(time).over(Window.partitionBy(*by).orderBy(time, tie))
    return gaps_and_islands(df.withColumn("_new", before.isNull() | (F.col(time) - before > gap)), by, [time, tie], F.col("_new")).drop("_new").withColumnRenamed("island", "session")

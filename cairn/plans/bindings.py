"""Frame, feature and stream views of the input tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import table

#: Features that the table of vectors gives each frame.
PER_FRAME = 25

FEATURES_SQL = f"""features AS (
    SELECT vec_id // {PER_FRAME} AS row_id, vec_id % {PER_FRAME} AS feature_id, CAST(embedding AS DOUBLE[]) AS descriptor,
           100 * CAST(embedding[1] AS DOUBLE) AS x, 100 * CAST(embedding[2] AS DOUBLE) AS y, (vec_id * 37 % 100) / 100.0 AS score, label
    FROM embeddings)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, feature_id, descriptor, x, y, score, label): a frame is 25 vectors in a row."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(
        F.floor(F.col("vec_id") / PER_FRAME).alias("row_id"),
        F.pmod("vec_id", F.lit(PER_FRAME)).alias("feature_id"),
        F.col("embedding").cast("array<double>").alias("descriptor"),
        (100 * F.col("embedding")[0].cast("double")).alias("x"),
        (100 * F.col("embedding")[1].cast("double")).alias("y"),
        (F.pmod(F.col("vec_id") * 37, F.lit(100)) / 100.0).alias("score"),
        "label",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with t, the time in seconds."""
    return table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


EVENTS_SQL = "timed AS (SELECT *, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 AS t FROM events)"

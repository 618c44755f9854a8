"""Landmarks that turn out to be one point: merged into the one with most sightings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.components import connected_components
from cairn.session import checkpoint


def merge_landmarks(sightings: DataFrame, same: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sightings, merges) of sightings (landmark, keyframe, ...) and pairs (a, b) that are one point.

    All that is linked is one landmark: the member with most sightings, the smaller id of equals. merges is (landmark, survivor, sightings) of the
    members, the survivor among them. Its members' sightings become its own; a keyframe that several saw keeps the survivor's, or else that of the
    member with more sightings, the smaller id of equals. Members without sightings count none; pairs with a null are left out, as are
    sightings of no landmark. Other columns stay.
    """
    sightings = sightings.where("landmark is not null")
    linked = connected_components(same.where("a is not null and b is not null"), "a", "b")
    counts = sightings.groupBy("landmark").agg(F.count(F.lit(1)).alias("_n"))
    members = checkpoint(linked.select(F.col("node").alias("landmark"), "component").join(counts, "landmark", "left").withColumn("_n", F.coalesce("_n", F.lit(0))))
    # a component is aggregated, never gathered
    heads = members.groupBy("component").agg(F.max(F.struct("_n", (-F.col("landmark")).alias("_l"))).alias("_h")).select("component", (-F.col("_h._l")).alias("survivor"))
    merges = checkpoint(members.join(heads, "component").select("landmark", "survivor", F.col("_n").cast("long").alias("sightings")))
    moved = sightings.join(merges.withColumnRenamed("sightings", "_n"), "landmark", "left")
    touched = moved.where("survivor is not null")
    order = Window.partitionBy("survivor", "keyframe").orderBy((F.col("landmark") != F.col("survivor")).cast("int"), F.desc("_n"), "landmark", *(c for c in sightings.columns if c not in ("landmark", "keyframe")))
    first = touched.withColumn("_r", F.row_number().over(order)).where("_r = 1").withColumn("landmark", F.col("survivor"))
    return moved.where("survivor is null").select(*sightings.columns).unionByName(first.select(*sightings.columns)), merges

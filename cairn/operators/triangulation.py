"""Points from all the frames that see them: linear triangulation by summed normal matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A landmark whose second smallest eigenvalue is not above this share of the largest is not a point.
FLAT = 1e-13
_CELLS = [(i, j) for i in range(4) for j in range(i, 4)]


def triangulate(observations: DataFrame, poses: DataFrame, by: str = "landmark", frame: str = "frame") -> DataFrame:
    """(by, views, x, y, z) of each landmark; null where its views don't make a point (one view, one ray, at infinity).

    observations: (by, frame, x, y), a direction (x, y, 1) in the camera's axes; poses: (frame, r, t) that
    bring points into them, row-major. A view's two equations are linear in the point, and the
    normal matrix of all of them is a sum, so each view adds ten numbers in partial aggregates and
    a task gets one row for each landmark, however many frames see it; the eigenvectors of all
    rows of a batch are taken at once. Views that are null, not finite or without a pose are left out.
    """
    seen = observations.select(F.col(by), F.col(frame).alias("_f"), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"))
    seen = seen.where((F.abs("_x") < float("inf")) & (F.abs("_y") < float("inf")) & F.col(by).isNotNull())
    placed = seen.join(poses.select(F.col(frame).alias("_f"), F.col("r").alias("_r"), F.col("t").alias("_t")), "_f")
    row = lambda i: [*(F.col("_r")[3 * i + j] for j in range(3)), F.col("_t")[i]]
    first, second = ([F.col(c) * high - low for high, low in zip(row(2), row(i), strict=True)] for i, c in enumerate(("_x", "_y")))
    placed = placed.select(by, F.array(*first).alias("_a"), F.array(*second).alias("_b"))
    sums = placed.groupBy(by).agg(F.count(F.lit(1)).alias("views"), *(F.sum(F.col("_a")[i] * F.col("_a")[j] + F.col("_b")[i] * F.col("_b")[j]).alias(f"c{i}{j}") for i, j in _CELLS))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            m = np.empty((len(rows), 4, 4))
            for i, j in _CELLS:
                m[:, i, j] = m[:, j, i] = rows[f"c{i}{j}"]
            # columns of one size, so that far points are not lost in rounding
            scale = 1 / np.sqrt(np.maximum(m[:, range(4), range(4)], 1e-300))
            values, vectors = np.linalg.eigh(m * scale[:, :, None] * scale[:, None, :])
            v = vectors[:, :, 0] * scale
            fine = (values[:, 1] > FLAT * values[:, 3]) & (np.abs(v[:, 3]) > 1e-10 * np.linalg.norm(v, axis=1))
            with np.errstate(all="ignore"):
                p = np.where(fine[:, None], v[:, :3] / v[:, 3:], np.nan)
            yield rows[[by, "views"]].assign(**{a: pd.Series(p[:, i], index=rows.index).astype(object).where(fine, None) for i, a in enumerate("xyz")})

    kind = observations.schema[by].dataType.simpleString()
    return sums.mapInPandas(solve, f"`{by}` {kind}, views long, x double, y double, z double")


def reprojections(observations: DataFrame, poses: DataFrame, points: DataFrame, by: str = "landmark", frame: str = "frame") -> DataFrame:
    """(by, views, front, rms, parallax): how many views have the point in front, the root mean square distance of its image from what they saw, and the widest angle between its ray in a view and its mean ray, in degrees."""
    seen = observations.select(by, F.col(frame).alias("_f"), F.col("x").alias("_x"), F.col("y").alias("_y")).join(poses.select(F.col(frame).alias("_f"), "r", "t"), "_f")
    at = [F.col("r")[3 * i] * F.col("x") + F.col("r")[3 * i + 1] * F.col("y") + F.col("r")[3 * i + 2] * F.col("z") + F.col("t")[i] for i in range(3)]
    # the ray in the world: from the centre, -r^T t, to the point
    ray = [F.col(a) + F.col("r")[i] * F.col("t")[0] + F.col("r")[3 + i] * F.col("t")[1] + F.col("r")[6 + i] * F.col("t")[2] for i, a in enumerate("xyz")]
    placed = seen.join(points.select(by, "x", "y", "z").where("x is not null"), by).select(by, "_x", "_y", F.array(*at).alias("_p"), F.array(*ray).alias("_d"))
    size = F.sqrt(F.col("_d")[0] * F.col("_d")[0] + F.col("_d")[1] * F.col("_d")[1] + F.col("_d")[2] * F.col("_d")[2])
    miss = F.pow(F.col("_p")[0] / F.col("_p")[2] - F.col("_x"), F.lit(2.0)) + F.pow(F.col("_p")[1] / F.col("_p")[2] - F.col("_y"), F.lit(2.0))
    placed = placed.withColumn("_u", F.transform("_d", lambda v: v / size))
    mean = placed.groupBy(by).agg(F.count(F.lit(1)).alias("views"), F.count_if(F.col("_p")[2] > 0).alias("front"), F.sqrt(F.avg(miss)).alias("rms"), *(F.avg(F.col("_u")[i]).alias(f"_m{i}") for i in range(3)))
    inner = sum((F.col("_u")[i] * F.col(f"_m{i}") for i in (1, 2)), F.col("_u")[0] * F.col("_m0")) / F.sqrt(F.col("_m0") ** 2 + F.col("_m1") ** 2 + F.col("_m2") ** 2)
    wide = placed.join(mean, by).groupBy(by).agg(F.max(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner))))).alias("parallax"))
    return mean.select(by, "views", "front", "rms").join(wide, by)

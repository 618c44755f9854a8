"""Truncated signed distances of rays, summed by voxel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a packed voxel key and its coordinates' bias.
SEGMENT_BITS, AXIS_BITS, BIAS = 10, 18, 1 << 17


def pack_key(segment, x, y, z):
    """A voxel's 64-bit key; null outside the range."""
    inside = (segment >= 0) & (segment < 1 << SEGMENT_BITS)
    key = segment.cast("long")
    for axis in (x, y, z):
        inside = inside & (axis >= -BIAS) & (axis < BIAS)
        key = F.shiftleft(key, AXIS_BITS).bitwiseOR(axis.cast("long") + BIAS)
    return F.when(inside, key)


def walk(origins: np.ndarray, points: np.ndarray, voxel: float, truncation: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ray, cell, signed distance) of the voxels that each ray crosses within truncation of its end, all rays a cell at a time.

    Rays without a finite length have none.
    """
    ray = points - origins
    length = np.linalg.norm(ray, axis=1)
    live = np.flatnonzero(np.isfinite(length) & (length > 0))
    origins, length = origins[live], length[live]
    direction = ray[live] / length[:, None]
    start, stop = np.maximum(0.0, length - truncation), length + truncation
    at = origins + direction * start[:, None]
    cell, step = np.floor(at / voxel).astype(np.int64), np.sign(direction).astype(np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        each = np.where(step != 0, voxel / np.abs(direction), np.inf)
        following = np.where(step != 0, start[:, None] + ((cell + (step > 0)) * voxel - at) / direction, np.inf)
    rays, cells, distances = [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)], [np.zeros(0)]
    on = np.arange(len(live))
    while len(on):
        distance = length[on] - (((cell[on] + 0.5) * voxel - origins[on]) * direction[on]).sum(1)
        near = np.abs(distance) <= truncation
        rays.append(live[on[near]])
        cells.append(cell[on[near]])
        distances.append(distance[near])
        axis = following[on].argmin(1)
        more = following[on, axis] <= stop[on]
        on, axis = on[more], axis[more]
        cell[on, axis] += step[on, axis]
        following[on, axis] += each[on, axis]
    return np.concatenate(rays), np.concatenate(cells), np.concatenate(distances)


def ray_cells(origin: np.ndarray, point: np.ndarray, voxel: float, truncation: float) -> list[tuple[int, int, int, float]]:
    """(x, y, z, signed distance) of one ray's voxels, in order."""
    _, cells, distances = walk(np.array([origin], float), np.array([point], float), voxel, truncation)
    return [(*map(int, c), float(d)) for c, d in zip(cells, distances, strict=True)]


def ray_samples(samples: DataFrame, by: list[str], voxel: float, truncation: float) -> DataFrame:
    """(by, ix, iy, iz, w, wd): for each cell that a sample's ray crosses near its end the sample's weight and weighted signed distance.

    samples has by (longs), px, py, pz, ox, oy, oz and weight. Null or non-finite coordinates and rays without length are left out.
    """
    columns = ["px", "py", "pz", "ox", "oy", "oz", "weight"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), 1000):
                frame = whole.iloc[at : at + 1000]
                frame = frame[np.isfinite(frame[columns].to_numpy(float)).all(1)]
                values = frame[columns].to_numpy(float)
                ray, cells, distance = walk(values[:, 3:6], values[:, :3], voxel, truncation)
                weight = values[ray, 6]
                yield pd.DataFrame({**{b: frame[b].to_numpy()[ray] for b in by}, "ix": cells[:, 0], "iy": cells[:, 1], "iz": cells[:, 2], "w": weight, "wd": weight * distance})

    rows = samples.select(*(F.col(b).cast("long").alias(b) for b in by), *(F.col(c).cast("double").alias(c) for c in columns))
    return rows.mapInPandas(run, "".join(f"`{b}` long, " for b in by) + "ix long, iy long, iz long, w double, wd double")


def integrate(samples: DataFrame, voxel: float, truncation: float) -> DataFrame:
    """Per (segment, ix, iy, iz): sum of weights, mean signed distance, rays, of samples as in ray_samples; cells are summed before and after the shuffle."""
    cells = ray_samples(samples, ["segment"], voxel, truncation)
    return cells.groupBy("segment", "ix", "iy", "iz").agg(F.sum("w").alias("weight"), (F.sum("wd") / F.sum("w")).alias("distance"), F.count(F.lit(1)).alias("rays"))


def point_voxels(points: DataFrame, voxel: float, axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """points with their voxel's ix, iy, iz."""
    return points.select("*", *(F.floor(F.col(a) / voxel).cast("long").alias(f"i{n}") for a, n in zip(axes, "xyz", strict=True)))


def inherit(current: DataFrame, previous: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """current with the values of the same voxel in previous, zero where it is new."""
    return current.join(previous.select(*keys, *values), keys, "left").fillna(0, values)

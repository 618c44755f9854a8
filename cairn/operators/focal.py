"""Focal length and radial distortion from pairs of frames, on a grid of both.

For a right k1 the undistorted matches of a pair fit one fundamental matrix, and for a right
focal length that matrix becomes an essential one, whose two singular values are equal. A pair
gives a residual for each k1 and, for each k1 and field of view, the relative gap of the two
values: its cost curve. Pairs that tell nothing (few inliers, a homography does as well, a
flat curve) are counted and left out. Fits are per pair, in tasks; the curves are arrays that
Spark sums cell by cell, in partial aggregates, so the mean curve costs one row per cell
whatever the number of pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.motion import bound
from cairn.operators import twoview

FITS = "first long, second long, matches long, inliers long, status string, residuals array<double>, matrices array<array<double>>"


@dataclass(frozen=True)
class Grid:
    """Fields of view in degrees and distortions that are tried, which pairs of a stream are taken and what a pair needs; thresholds in pixels, displacement in widths, gaps in frames."""

    # fixed values of the contract
    min_hfov: float = 30.0
    max_hfov: float = 150.0
    hfov_step: float = 1.0
    min_k1: float = -0.6
    max_k1: float = 0.3
    k1_step: float = 0.02
    min_displacement: float = 0.02
    max_gap: int = 90
    pair_stride: int = 10
    min_common: int = 80
    min_inliers: int = 60
    candidate_threshold: float = 6.0
    residual_threshold: float = 2.0
    samples: int = 300
    homography_ratio: float = 0.8
    min_curve_depth: float = 0.02
    hfovs: tuple[float, ...] = field(init=False)
    k1s: tuple[float, ...] = field(init=False)

    def __post_init__(self) -> None:
        if not (0 < self.min_hfov <= self.max_hfov < 180 and self.hfov_step > 0 and self.min_k1 <= self.max_k1 and self.k1_step > 0):
            raise ValueError("the grid must rise, fields of view must be between 0 and 180 degrees")
        steps = lambda a, b, s: tuple(round(a + i * s, 9) + 0.0 for i in range(int((b - a) / s + 1e-9) + 1))
        object.__setattr__(self, "hfovs", steps(self.min_hfov, self.max_hfov, self.hfov_step))
        object.__setattr__(self, "k1s", steps(self.min_k1, self.max_k1, self.k1_step))


def undistorted(points: np.ndarray, width: int, height: int, k1: float) -> tuple[np.ndarray, np.ndarray]:
    """(points, squared local scale): centred points over one plus k1 times their squared radius in half diagonals, and how much that stretches, the geometric mean of both directions."""
    half = 0.25 * (width * width + height * height)
    r2 = (points * points).sum(1) / half
    d = 1 + k1 * r2
    return points / d[:, None], np.sqrt(np.abs(1 - k1 * r2) / d**3)


def fit_pair(seed: list[int], a: np.ndarray, b: np.ndarray, width: int, height: int, grid: Grid) -> dict:
    """inliers, status, and where the status is 'fitted' a residual and a fundamental matrix for each k1, in units of the width."""
    centre = np.array([0.5 * (width - 1), 0.5 * (height - 1)])
    pa, pb = a - centre, b - centre
    rng, draw = np.random.default_rng(seed), {"most": grid.samples, "sure": 0.9999}
    tight = grid.residual_threshold / width
    models = {"solve": twoview.fundamentals, "errors": twoview.sampson, "refit": twoview.fundamentals}
    _, loose = twoview.consensus(pa / width, pb / width, 8, threshold=grid.candidate_threshold / width, rng=rng, **models, **draw)
    out = {"inliers": int(loose.sum()), "status": "weak", "residuals": None, "matrices": None}
    if loose.sum() < grid.min_inliers:
        return out
    _, close = twoview.consensus(pa / width, pb / width, 8, threshold=tight, rng=rng, **models, **draw)
    _, flat = twoview.consensus(pa / width, pb / width, 4, twoview.homographies, twoview.transfer, tight, rng=rng, refit=twoview.homographies, share=grid.homography_ratio * close.mean(), **draw)
    if flat.sum() > grid.homography_ratio * max(int(close.sum()), 1):
        return out | {"status": "homography"}
    residuals, matrices = [], []
    for k1 in grid.k1s:
        (ua, sa), (ub, sb) = undistorted(pa[loose], width, height, k1), undistorted(pb[loose], width, height, k1)
        ua, ub, scale = ua / width, ub / width, (sa + sb) / 2
        use = np.ones(len(ua))
        for _ in range(3):  # on the loose inliers, then twice on what is close
            m = twoview.fundamentals(ua[None], ub[None], use[None])[0] if use.sum() >= 8 else np.full((3, 3), np.nan)
            error = twoview.sampson(m[None], ua, ub)[0] / np.maximum(scale, 1e-12)
            if not np.isfinite(m).all():
                break
            use = (error < 2 * tight).astype(float)
        fine = np.isfinite(m).all()
        residuals.append(float(np.minimum(error, tight) ** 2 @ np.ones(len(error)) / len(error)) if fine else tight * tight)
        matrices.append(m.ravel().tolist() if fine else None)
    return out | {"status": "fitted", "residuals": residuals, "matrices": matrices}


def pair_fits(matches: DataFrame, width: int, height: int, grid: Grid | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """FITS of matches (by, first, second, x1, y1, x2, y2) in pixels, a row per pair; by are columns of longs. Matches that are not finite are left out."""
    grid = grid or Grid()
    names, keys = ["x1", "y1", "x2", "y2"], [*by, "first", "second"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = rows.sort_values(names)[names].to_numpy(float)
        found = fit_pair([int(k) for k in key], p[:, :2], p[:, 2:], width, height, grid)
        return pd.DataFrame([{**dict(zip(keys, key, strict=True)), "matches": len(p), **found}])

    fine = " and ".join(f"abs({c}) < double('infinity')" for c in names)
    return matches.select(*keys, *names).where(fine).groupBy(*keys).applyInPandas(run, "".join(f"`{b}` long, " for b in by) + FITS)


def essential_gap(m: Column, focal: Column) -> Column:
    """(s1 - s2) / (s1 + s2) of the singular values of diag(focal, focal, 1) m diag(focal, focal, 1), m of rank two and row-major; 1 where both are zero.

    Of two values the sum of squares is the matrix' squared norm and the squared product the
    sum of its squared two-by-two minors, so no decomposition is needed.
    """

    def gap(e: Column) -> Column:
        square = sum((e[i] * e[i] for i in range(1, 9)), e[0] * e[0])
        pairs = ((0, 1), (0, 2), (1, 2))
        minors = [e[3 * r + c] * e[3 * s + d] - e[3 * r + d] * e[3 * s + c] for r, s in pairs for c, d in pairs]
        twice = 2 * F.sqrt(sum((x * x for x in minors[1:]), minors[0] * minors[0]))
        return F.when(square + twice > 0, F.sqrt(F.greatest(square - twice, F.lit(0.0)) / (square + twice))).otherwise(1.0)

    return bound(F.array(*(m[3 * r + c] * (F.lit(1.0) if r == c == 2 else focal if 2 in (r, c) else focal * focal) for r in range(3) for c in range(3))), gap)


def focal_of(hfov: Column) -> Column:
    """The focal length, in widths, of a horizontal field of view in degrees."""
    return 0.5 / F.tan(F.radians(hfov) / 2)


def cost_curve(m: Column, hfovs: tuple[float, ...]) -> Column:
    """The gap at every field of view, as an array; a missing matrix is as bad as can be."""
    return F.transform(F.array(*map(F.lit, hfovs)), lambda h: F.coalesce(bound(focal_of(h), lambda f: essential_gap(m, f)), F.lit(1.0)))


def curve_minimum(grid: tuple[float, ...], costs: Column) -> Column:
    """Where the costs over an even grid are least, refined by a parabola through the neighbours and at most a step away."""
    step, at = grid[1] - grid[0] if len(grid) > 1 else 0.0, F.array_position(costs, F.array_min(costs))

    def refined(k: Column) -> Column:
        left, middle, right = F.get(costs, k - 2), F.get(costs, k - 1), F.get(costs, k)
        bend = left - 2 * middle + right
        inside = (k > 1) & (k < len(grid)) & (bend > 0)
        return F.get(F.array(*map(F.lit, grid)), (k - 1).cast("int")) + F.when(inside, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (left - right) / (2 * bend)))).otherwise(0.0) * step

    return bound(at.cast("int"), refined)


def pair_curves(fits: DataFrame, grid: Grid | None = None) -> DataFrame:
    """fits with curves (an array per k1), minima (a field of view per k1) and status: 'flat' where the curve of the pair's own best k1 has no depth, else 'used'."""
    grid = grid or Grid()
    curves = fits.withColumn("curves", F.when(F.col("status") == "fitted", F.transform("matrices", lambda m: cost_curve(m, grid.hfovs))))
    own = F.element_at("curves", F.array_position("residuals", F.array_min("residuals")).cast("int"))
    flat = F.array_max(own) - F.array_min(own) < grid.min_curve_depth
    curves = curves.withColumn("minima", F.transform("curves", lambda c: curve_minimum(grid.hfovs, c)))
    return curves.withColumn("status", F.when(F.col("status") != "fitted", F.col("status")).when(flat, "flat").otherwise("used"))


def grid_sums(curves: DataFrame, by: list[str]) -> DataFrame:
    """(by, k, h, pairs, cost): for each cell of the grid, by the places of k1 and field of view, the number of used pairs and the sum of their costs."""
    cells = curves.where("status = 'used'").select(*by, F.posexplode("curves").alias("k", "curve")).select(*by, "k", F.posexplode("curve").alias("h", "cost"))
    return cells.groupBy(*by, "k", "h").agg(F.count("cost").alias("pairs"), F.sum("cost").alias("cost"))


def residual_sums(curves: DataFrame, by: list[str]) -> DataFrame:
    """(by, k, pairs, residual): for each k1 the number of pairs with a fit, flat ones included, and the sum of their residuals."""
    return curves.where("residuals is not null").select(*by, F.posexplode("residuals").alias("k", "residual")).groupBy(*by, "k").agg(F.count("residual").alias("pairs"), F.sum("residual").alias("residual"))


def estimates(costs: DataFrame, residuals: DataFrame, by: list[str], width: int, grid: Grid | None = None) -> DataFrame:
    """(by, pairs, k1, hfov, focal): the least root mean square residual's k1 and the least mean cost's field of view at it, between the curves of the two nearest k1; focal in pixels.

    costs and residuals are the rows of grid_sums and residual_sums: a group has as many as the grid has cells.
    """
    grid = grid or Grid()
    n_k, n_h = len(grid.k1s), len(grid.hfovs)
    listed = lambda place, value: F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda x: x[value])
    rms = residuals.withColumn("rms", F.sqrt(F.col("residual") / F.col("pairs"))).groupBy(*by).agg(listed("k", "rms").alias("rms"))
    mean = costs.withColumn("cell", F.col("k") * n_h + F.col("h")).withColumn("mean", F.col("cost") / F.col("pairs"))
    mean = mean.groupBy(*by).agg(F.max("pairs").alias("pairs"), listed("cell", "mean").alias("mean"))
    both = (mean.join(rms, by) if by else mean.crossJoin(rms)).withColumn("k1", curve_minimum(grid.k1s, F.col("rms")))  # without by, one row each
    step = grid.k1s[1] - grid.k1s[0] if n_k > 1 else 1.0
    place = F.greatest(F.lit(0.0), F.least(F.lit(float(n_k - 1)), (F.col("k1") - grid.k1s[0]) / step))
    both = both.withColumn("row", F.least(F.floor(place), F.lit(n_k - 1)).cast("int")).withColumn("part", place - F.col("row"))
    curve = F.transform(F.sequence(F.lit(0), F.lit(n_h - 1)), lambda h: (1 - F.col("part")) * F.get("mean", F.col("row") * n_h + h) + F.col("part") * F.get("mean", F.least(F.col("row") + 1, F.lit(n_k - 1)) * n_h + h))
    found = both.withColumn("curve", curve).withColumn("hfov", curve_minimum(grid.hfovs, F.col("curve")))
    return found.select(*by, "pairs", "k1", "hfov", (focal_of(F.col("hfov")) * width).alias("focal"))

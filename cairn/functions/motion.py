"""Rigid and similarity motions, filters and gates, as expressions. Rotations are row-major arrays of 9, shifts arrays of 3."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType

from cairn.functions.geometry import compose, distorted, matrix_quaternion


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: written out, an expression that uses it often would be copied each time."""
    return F.transform(F.array(value), use)[0]


def rotation_of(x: Column, y: Column, z: Column) -> Column:
    """The rotation about the vector by its length in radians (the exponential map)."""
    return bound(F.array(x, y, z), _rotation)


def _rotation(v: Column) -> Column:
    square = v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
    angle = F.sqrt(square)
    # both factors by their series where the angle is too small to divide by
    first = F.when(angle > 1e-6, F.sin(angle) / angle).otherwise(1 - square / 6)
    second = F.when(angle > 1e-6, (1 - F.cos(angle)) / square).otherwise(0.5 - square / 24)
    turned = {(0, 1): -v[2], (0, 2): v[1], (1, 0): v[2], (1, 2): -v[0], (2, 0): -v[1], (2, 1): v[0]}
    cells = lambda f: F.array(*(f[1] * v[i] * v[j] + (1 - f[1] * f[2] if i == j else f[0] * turned[i, j]) for i in range(3) for j in range(3)))
    return bound(F.array(first, second, square), cells)


def vector_of(r: Column) -> Column:
    """The rotation's vector (the logarithm), through its quaternion, so half turns are no special case."""

    def scaled(q: Column) -> Column:
        size = F.sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
        return bound(F.when(size > 1e-12, 2 * F.atan2(size, q[0]) / size).otherwise(2.0), lambda factor: F.array(*(factor * q[i] for i in (1, 2, 3))))

    return bound(r, lambda own: bound(matrix_quaternion(own), scaled))


def inverse(r: Column, t: Column) -> Column:
    """(r, t) of the motion back."""
    back = [r[3 * j + i] for i in range(3) for j in range(3)]
    shift = [-(back[3 * i] * t[0] + back[3 * i + 1] * t[1] + back[3 * i + 2] * t[2]) for i in range(3)]
    return F.struct(F.array(*back).alias("r"), F.array(*shift).alias("t"))


def fraction(r: Column, t: Column, share: Column | float) -> Column:
    """(r, t) of a share of the motion: that share of its angle and of its shift."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    turn = bound(vector_of(r), lambda v: rotation_of(*(v[i] * share for i in range(3))))
    return F.struct(turn.alias("r"), F.array(*(t[i] * share for i in range(3))).alias("t"))


def perturbed(r: Column, t: Column, delta: list[Column]) -> Column:
    """(r, t) after a small motion on the left: a rotation vector, then a shift."""
    return compose(rotation_of(*delta[:3]), F.array(*delta[3:]), r, t)


def compose_similar(s1: Column, r1: Column, t1: Column, s2: Column, r2: Column, t2: Column) -> Column:
    """(s, r, t) of the similarity that applies the second one first."""
    rigid = compose(r1, t1, r2, F.transform(t2, lambda x: x * s1))
    return F.struct((s1 * s2).alias("s"), rigid["r"].alias("r"), rigid["t"].alias("t"))


def brown_undistort(x: Column, y: Column, k: tuple[float, float, float, float, float], steps: int = 20) -> Column:
    """The point that brown_distort maps to (x, y), by fixed-point steps from it, which a batch takes together."""

    @F.pandas_udf("x double, y double")
    def found(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        u, v = x, y = xs.to_numpy(float), ys.to_numpy(float)
        with np.errstate(all="ignore"):
            for _ in range(steps):
                seen = distorted(u, v, k)
                u, v = u + x - seen[0], v + y - seen[1]
        return pd.DataFrame({"x": u, "y": v})

    known, at = x.isNotNull() & y.isNotNull(), found(x.cast("double"), y.cast("double"))
    return F.struct(F.when(known, at["x"]).alias("x"), F.when(known, at["y"]).alias("y"))


def updated(predicted: Column, variance: Column, flow_variance: Column, measured: Column, measured_variance: Column) -> Column:
    """(value, variance) of a one-dimensional Kalman update; without a flow variance above 0 the measurement replaces the state."""
    before = variance + flow_variance
    gain = before / (before + measured_variance)
    known = F.coalesce(flow_variance > 0, F.lit(False)) & predicted.isNotNull()
    return F.struct(F.when(known, predicted + gain * (measured - predicted)).otherwise(measured).alias("value"), F.when(known, (1 - gain) * before).otherwise(measured_variance).alias("variance"))


def fused(state: Column, variance: Column, measured: Column, measured_variance: Column, outlier_sigmas: float = 3.0, min_sigma: float = 0.0, measurement_sigma: float = 0.0) -> Column:
    """(value, variance) of an inverse depth after a measurement.

    Estimates that agree are multiplied; of two that don't, a more certain newcomer replaces
    the state, else the state stays and is doubted twice as much. Without a state the
    measurement is it, without a measurement the state stays. The variance has a floor.

    What the measurement's own variance does not cover, the poses and the model, is a share of its
    value, measurement_sigma, whose square is added.
    """
    if measurement_sigma:
        measured_variance = measured_variance + measurement_sigma * measurement_sigma * measured * measured
    total, gap = variance + measured_variance, measured - state
    agree = gap * gap <= outlier_sigmas * outlier_sigmas * total
    value = F.when(measured.isNull(), state).when(state.isNull(), measured).when(agree, (state * measured_variance + measured * variance) / total).when(measured_variance < variance, measured).otherwise(state)
    spread = F.when(measured.isNull(), variance).when(state.isNull(), measured_variance).when(agree, variance * measured_variance / total).when(measured_variance < variance, measured_variance).otherwise(2 * variance)
    floor = min_sigma * value
    return F.struct(value.alias("value"), F.when(measured.isNull() | state.isNull(), spread).otherwise(F.greatest(spread, floor * floor)).alias("variance"))


def projected_variance(x: Column, y: Column, z: Column, fx: float, fy: float, covariance: list[list[float]]) -> Column:
    """Summed variance of both pixel coordinates of a point in camera axes, under the pose's 6 by 6 error covariance; null behind the camera."""
    inverse_z = 1 / z
    slopes = ((fx * inverse_z, F.lit(0.0), -fx * x * inverse_z * inverse_z), (F.lit(0.0), fy * inverse_z, -fy * y * inverse_z * inverse_z))
    total = F.lit(0.0)
    for a, b, c in slopes:
        row = (c * y - b * z, a * z - c * x, b * x - a * y, a, b, c)  # turning the point moves it across it, shifting it along
        for i in range(6):
            for j in range(6):
                if covariance[i][j]:
                    total = total + row[i] * row[j] * covariance[i][j]
    return F.when(z > 1e-6, total)


def image_sigma(variance: Column) -> Column:
    """An aggregate of projected_variance: the root mean square error of a pixel coordinate, infinite where no point is in front."""
    return F.when(F.count(variance) > 0, F.sqrt(F.sum(variance) / (2 * F.count(variance)))).otherwise(F.lit(float("inf")))


def triangulated(point: list[Column], depths: list[Column], errors: list[Column], angle: Column, max_error: float = 3.0, min_angle: float = 1.0) -> Column:
    """The gate of a triangulated point: finite, in front of both cameras, near both of its images, seen at an angle from min_angle to 90 degrees."""
    fine = F.lit(True)
    for c in point:
        fine = fine & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    for d in depths:
        fine = fine & (d > 0)
    for e in errors:
        fine = fine & (e <= max_error)
    return F.coalesce(fine & (angle >= min_angle) & (angle < 90), F.lit(False))


def audited_depth(truth: Column, rho: Column, variance: Column) -> Column:
    """Whether a depth can be audited: a true depth above 0, an inverse depth above 0, a finite variance."""
    return F.coalesce((truth > 0) & (rho > 0) & ~F.isnan(variance) & (variance < float("inf")), F.lit(False))


@F.pandas_udf(BinaryType())
def half_bytes(values: pd.Series) -> pd.Series:
    """Numbers as 16-bit floats, little-endian; all rows of a batch are converted at once."""
    there = values.notna().to_numpy()
    kept = values[there]
    sizes = np.array([len(v) for v in kept], np.int64)
    raw = (np.concatenate(kept.to_list()).astype(np.float64) if len(kept) else np.zeros(0)).astype("<f2").tobytes()
    ends = 2 * np.cumsum(sizes)
    out = pd.Series([None] * len(values), index=values.index, dtype=object)
    out[there] = [raw[end - 2 * size : end] for end, size in zip(ends.tolist(), sizes.tolist(), strict=True)]
    return out


@F.pandas_udf(ArrayType(FloatType()))
def from_half_bytes(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in raw:
        there = part.notna().to_numpy()
        kept = part[there]
        flat = np.frombuffer(b"".join(kept), "<f2").astype(np.float32)
        out = pd.Series([None] * len(part), index=part.index, dtype=object)
        ends = np.cumsum([len(b) // 2 for b in kept])
        out[there] = pd.Series(np.split(flat, ends[:-1]) if len(kept) else [], index=kept.index, dtype=object)
        yield out


def inverse_similar(s: Column, r: Column, t: Column) -> Column:
    """(s, r, t) of the similarity back."""
    rigid = inverse(r, t)
    return F.struct((1 / s).alias("s"), rigid["r"].alias("r"), F.transform(rigid["t"], lambda x: x / s).alias("t"))


def similar_error(s: Column, r: Column, t: Column) -> Column:
    """How far a similarity is from none, as seven numbers: its rotation's vector, its shift, the logarithm of its scale."""
    return F.concat(vector_of(r), t, F.array(F.log(s)))


def _adjoint(s: Column, r: Column, t: Column) -> list[list[Column | None]]:
    """similar_adjoint's entries, None for those that are always zero."""
    across = ((None, -t[2], t[1]), (t[2], None, -t[0]), (-t[1], t[0], None))
    rows = [[*(r[3 * i + j] for j in range(3)), *[None] * 4] for i in range(3)]
    for i in range(3):
        turned = [sum((across[i][k] * r[3 * k + j] for k in range(3) if k != i), F.lit(0.0)) for j in range(3)]
        rows.append([*turned, *(s * r[3 * i + j] for j in range(3)), -t[i]])
    return [*rows, [*[None] * 6, F.lit(1.0)]]


def similar_adjoint(s: Column, r: Column, t: Column) -> Column:
    """The 7 by 7 matrix, row-major, that takes small changes (turn, shift, log scale) made before the similarity to those after it that do the same."""
    return F.array(*(F.lit(0.0) if x is None else x for row in _adjoint(s, r, t) for x in row))


def carried(s: Column, r: Column, t: Column, covariance: Column) -> Column:
    """a c a^T with the similarity's adjoint a: a covariance of changes before it, 7 by 7 and row-major, as one of changes after it."""
    shape = [[x is not None for x in row] for row in _adjoint(s, r, t)]

    def dot(left: list[tuple[int, Column]], right: list[Column]) -> Column:
        return sum((x * right[k] for k, x in left[1:]), left[0][1] * right[left[0][0]])

    def products(both: Column) -> Column:
        a, c = both["a"], both["c"]
        rows = [[(k, a[7 * i + k]) for k in range(7) if shape[i][k]] for i in range(7)]
        half = F.array(*(dot(rows[i], [c[7 * k + j] for k in range(7)]) for i in range(7) for j in range(7)))
        return bound(F.struct(half.alias("h"), a.alias("a")), lambda x: F.array(*(dot([(k, x["a"][7 * j + k]) for k in range(7) if shape[j][k]], [x["h"][7 * i + k] for k in range(7)]) for i in range(7) for j in range(7))))

    return bound(F.struct(similar_adjoint(s, r, t).alias("a"), covariance.alias("c")), products)


def squared_length(vector: Column, covariance: Column, size: int = 7) -> Column:
    """v^T c^-1 v of a positive definite c, row-major: one row after the other is eliminated, with the vector alongside; null where c is not positive definite."""

    def eliminate(m: Column, n: int) -> Column:
        """m: n rows of n + 1 numbers, the last one the vector's, and behind them the sum so far."""
        wide = n + 1
        if n == 0:
            return m[0]
        pivot = F.when(m[0] > 0, m[0])
        rest = [m[i * wide + j] - m[i * wide] * m[j] / pivot for i in range(1, n) for j in range(1, wide)]
        return bound(F.array(*rest, m[n * wide] + m[n] * m[n] / pivot), lambda x: eliminate(x, n - 1))

    cells = [x for i in range(size) for x in (*(covariance[size * i + j] for j in range(size)), vector[i])]
    return bound(F.array(*cells, F.lit(0.0)), lambda m: eliminate(m, size))


def _rotation_vectors(r: np.ndarray) -> np.ndarray:
    """vector_of for a stack (n, 3, 3)."""
    x, y, z = r[:, 0, 0], r[:, 1, 1], r[:, 2, 2]
    trace = x + y + z
    best = np.argmax(np.stack([trace, x, y, z]), axis=0)
    a, b, c = r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]
    d, e, f = r[:, 0, 1] + r[:, 1, 0], r[:, 0, 2] + r[:, 2, 0], r[:, 1, 2] + r[:, 2, 1]
    s = [np.sqrt(np.maximum(0.0, v)) for v in (1 + trace, 1 + x - y - z, 1 - x + y - z, 1 - x - y + z)]
    forms = ((s[0] / 2, a / (2 * s[0]), b / (2 * s[0]), c / (2 * s[0])), (a / (2 * s[1]), s[1] / 2, d / (2 * s[1]), e / (2 * s[1])), (b / (2 * s[2]), d / (2 * s[2]), s[2] / 2, f / (2 * s[2])), (c / (2 * s[3]), e / (2 * s[3]), f / (2 * s[3]), s[3] / 2))
    q = np.array(forms).transpose(0, 2, 1)[best, np.arange(len(r))]
    q = np.where(q[:, :1] < 0, -q, q)
    size = np.sqrt((q[:, 1:] * q[:, 1:]).sum(1))
    return q[:, 1:] * np.where(size > 1e-12, 2 * np.arctan2(size, q[:, 0]) / size, 2.0)[:, None]


def _reciprocal_distances(rows: np.ndarray) -> np.ndarray:
    """reciprocal_distance of rows (n, 124), NaN where the covariance is not positive definite."""
    s1, r1, t1, c1, s2, r2, t2, c2 = np.split(rows, np.cumsum([1, 9, 3, 49, 1, 9, 3]), axis=1)
    r1, r2, n = r1.reshape(-1, 3, 3), r2.reshape(-1, 3, 3), len(rows)
    error = np.concatenate([_rotation_vectors(r1 @ r2), (r1 @ (t2 * s1)[:, :, None])[:, :, 0] + t1, np.log(s1 * s2)], 1)
    across = np.zeros((n, 3, 3))
    for i, j, k, sign in ((0, 1, 2, -1), (0, 2, 1, 1), (1, 0, 2, 1), (1, 2, 0, -1), (2, 0, 1, -1), (2, 1, 0, 1)):
        across[:, i, j] = sign * t1[:, k]
    adjoint = np.zeros((n, 7, 7))
    adjoint[:, :3, :3], adjoint[:, 3:6, :3], adjoint[:, 3:6, 3:6], adjoint[:, 3:6, 6], adjoint[:, 6, 6] = r1, across @ r1, s1[:, :, None] * r1, -t1, 1
    total = c1.reshape(-1, 7, 7) + adjoint @ c2.reshape(-1, 7, 7) @ adjoint.transpose(0, 2, 1)
    # one row after the other is eliminated, with the vector alongside
    m, out = np.concatenate([total, error[:, :, None]], 2), np.zeros(n)
    for k in range(7):
        pivot = np.where(m[:, k, k] <= 0, np.nan, m[:, k, k])
        out += m[:, k, 7] * m[:, k, 7] / pivot
        m[:, k + 1 :, k + 1 :] -= (m[:, k, k + 1 : 7] / pivot[:, None])[:, :, None] * m[:, k, None, k + 1 :]
    return out


@F.arrow_udf(DoubleType())
def _reciprocal(rows: pa.Array) -> pa.Array:
    known = rows.is_valid().to_numpy(zero_copy_only=False)
    flat = rows.flatten()
    table = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, 124)
    out = np.full(len(rows), np.nan)
    with np.errstate(all="ignore"):
        out[known] = _reciprocal_distances(table)
    return pa.array(out, mask=np.isnan(out))


def reciprocal_distance(s1: Column, r1: Column, t1: Column, c1: Column, s2: Column, r2: Column, t2: Column, c2: Column) -> Column:
    """The squared Mahalanobis distance from nothing of a similarity after its supposed way back, (s1, r1, t1) after (s2, r2, t2), with the 7 by 7 covariances of both; null where their sum is not positive definite. A batch is worked out together."""
    each = (F.array(s1.cast("double")), r1, t1, c1, F.array(s2.cast("double")), r2, t2, c2)
    return _reciprocal(F.concat(*each))

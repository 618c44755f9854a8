"""Similarity motions between two sets of points: by sums, and robustly by samples. No group is gathered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import checkpoint, new_path, remove, wide_rows

NAMES = [f"s{i}" for i in range(3)] + [f"t{i}" for i in range(3)]
MODEL = "s double, r array<double>, t array<double>"
#: Samples that are drawn for a group.
HYPOTHESES = 128
#: Rows of a group that are packed into one, about, and numbers of a packed row: its coordinates and its threshold.
CHUNK, WIDTH = 1024, len(NAMES) + 1
#: Models that are scored on a chunk at once.
AT_ONCE = 64


def solve(cov: np.ndarray, spread: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scales, rotations, shifts) of a stack: cov is target by source, spread the source's variance, mean source and target (k, 6). A source without extent has scale 1."""
    u, d, v = np.linalg.svd(cov)
    d[..., 2] *= np.sign(np.linalg.det(u) * np.linalg.det(v))
    u[..., 2] *= np.sign(np.linalg.det(u) * np.linalg.det(v))[..., None]
    r = u @ v
    with np.errstate(all="ignore"):
        s = np.where(spread > 1e-18, d.sum(-1) / spread, 1.0)
    return s, r, mean[:, 3:] - s[:, None] * np.einsum("kij,kj->ki", r, mean[:, :3])


def moments() -> list[Column]:
    """Aggregates of s0..s2, t0..t2 that a similarity needs."""
    return [F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m_{c}") for c in NAMES), *(F.avg(F.col(a) * F.col(b)).alias(f"m_{a}_{b}") for i, a in enumerate(NAMES) for b in NAMES[i:])]


def solved(sums: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, s, r, t, rms): the least-squares similarity of each row of moments()."""
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            mean = frame[[f"m_{c}" for c in NAMES]].to_numpy(float)
            second = np.empty((len(frame), 6, 6))
            for i, a in enumerate(NAMES):
                for j in range(i, 6):
                    second[:, i, j] = second[:, j, i] = frame[f"m_{a}_{NAMES[j]}"]
            cov = second - mean[:, :, None] * mean[:, None, :]
            spread = np.trace(cov[:, :3, :3], axis1=1, axis2=2)
            s, r, t = solve(cov[:, 3:, :3], spread, mean)
            off = np.trace(cov[:, 3:, 3:], axis1=1, axis2=2) + s * s * spread - 2 * s * np.einsum("kij,kij->k", r, cov[:, 3:, :3])
            yield frame[[*by, "n"]].assign(s=s, r=list(r.reshape(-1, 9)), t=list(t), rms=np.sqrt(np.maximum(off, 0)))

    return sums.mapInPandas(run, "".join(f"`{b}` {kinds[b]}, " for b in by) + f"n long, {MODEL}, rms double")


def off(s: Column, r: Column, t: Column) -> Column:
    """The squared distance of the moved s0..s2 from t0..t2."""
    moved = [s * (r[3 * i] * F.col("s0") + r[3 * i + 1] * F.col("s1") + r[3 * i + 2] * F.col("s2")) + t[i] - F.col(f"t{i}") for i in range(3)]
    return moved[0] * moved[0] + moved[1] * moved[1] + moved[2] * moved[2]


def distances(s: np.ndarray, r: np.ndarray, t: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The squared distances (models, rows) of the moved s0..s2 of packed rows from t0..t2."""
    moved = ((s[:, None, None] * r).reshape(-1, 3) @ rows[:, :3].T).reshape(len(s), 3, -1)
    moved += t[:, :, None]
    moved -= rows[:, 3:6].T
    moved *= moved
    return moved.sum(1)


def drawn(pool: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hypothesis, s, r, t) of the samples that hashes (hypotheses, 3) draw from the ranked rows of a pool, without those that have no scale above zero."""
    pool = pool[np.argsort(pool[:, -1])][:, :6]
    at = np.sort(np.mod(hashes, len(pool)), axis=1)
    h = np.flatnonzero((at[:, 0] != at[:, 1]) & (at[:, 1] != at[:, 2]))
    p = pool[np.mod(hashes[h], len(pool))]  # (samples, points, coordinates)
    mean = p.mean(1)
    c = p - mean[:, None]
    s, r, t = solve(np.einsum("kpi,kpj->kij", c[..., 3:], c[..., :3]) / 3, (c[..., :3] ** 2).sum((1, 2)) / 3, mean)
    fine = np.isfinite(s) & (s > 0) & np.isfinite(t).all(1)
    return h[fine], s[fine], r[fine], t[fine]


def _packed(rows: DataFrame, by: list[str], numbers: list[str], out: str, most: int | None = None) -> DataFrame:
    """(by, out) of rows that come sorted by group: the numbers of a group's rows behind each other, of at most so many rows where most is given."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0

        def made() -> pa.RecordBatch:
            values = pa.array(np.concatenate(held).ravel())
            return pa.RecordBatch.from_arrays([*key.columns, pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)], [*by, out])

        for batch in batches:
            keys = batch.select(by)
            table = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in numbers], 1)
            change = np.zeros(max(0, batch.num_rows - 1), bool)
            for column in keys.columns:
                change |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(change) + 1).tolist()] if batch.num_rows else []
            for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                while start < end:
                    one = keys.slice(start, 1)
                    if key is not None and (not one.equals(key) or most is not None and size >= most):
                        yield made()
                        key, held, size = None, [], 0
                    key = key or one
                    stop = end if most is None else min(end, start + most - size)
                    held.append(table[start:stop])
                    start, size = stop, size + stop - start
        if key is not None:
            yield made()

    return rows.select(*by, *numbers).mapInArrow(run, ", ".join([*(f"`{b}` {kinds[b]}" for b in by), f"{out} array<double>"]))


def _numbers(column: pa.Array, width: int) -> list[np.ndarray]:
    """The rows of numbers, so wide, that each value of a column of flat arrays holds."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[x:y].reshape(-1, width) for x, y in zip(ends[:-1], ends[1:], strict=True)]


def _per_chunk(chunks: DataFrame, by: list[str], work: Callable[..., list[np.ndarray] | None], names: str, **widths: int) -> DataFrame:
    """(by, names) that work gives for the columns of each row of chunks, flat arrays of rows of so many numbers; a list of columns, or None."""
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}
    schema = ", ".join([*(f"`{b}` {kinds[b]}" for b in by), names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, of = [], []
            for k, values in enumerate(zip(*(_numbers(batch.column(c), w) for c, w in widths.items()), strict=True)):
                columns = work(*values)
                if columns is not None and len(columns[0]):
                    found.append(columns)
                    of.append(np.full(len(columns[0]), k))
            if found:
                keys = batch.select(by).take(pa.array(np.concatenate(of)))
                columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([*keys.columns, *columns], [*by, *(c.split()[0] for c in names.split(", "))])

    return chunks.mapInArrow(run, schema)


def _scored(rows: np.ndarray, pool: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """[hypothesis, rows within their thresholds] of the samples that any row is near."""
    h, s, r, t = drawn(pool, hashes)
    limit = rows[:, 6] * rows[:, 6]
    counts = [(distances(s[k : k + AT_ONCE], r[k : k + AT_ONCE], t[k : k + AT_ONCE], rows) <= limit).sum(1) for k in range(0, len(h), AT_ONCE)]
    n = np.concatenate([np.zeros(0, int), *counts])
    return [h[n > 0], n[n > 0]]


def _near(rows: np.ndarray, model: np.ndarray) -> np.ndarray:
    m = model[0]
    return rows[distances(m[:1], m[None, 1:10].reshape(1, 3, 3), m[None, 10:], rows)[0] <= rows[:, 6] * rows[:, 6], :6]


def _sums(rows: np.ndarray, model: np.ndarray) -> list[np.ndarray]:
    """[n, sums, sums of products] of the rows near a model (scale, rotation, shift)."""
    near = _near(rows, model)
    products = near.T @ near
    return [np.array([x]) for x in (len(near), *near.sum(0), *(products[i, j] for i in range(6) for j in range(i, 6)))] if len(near) else [np.zeros(0)]


def named(pairs: DataFrame, by: list[str], source: tuple[str, str, str], target: tuple[str, str, str], *more: str) -> DataFrame:
    """by, s0..t2 as doubles and more; rows with a null key or a coordinate that is not finite are left out."""
    rows = pairs.select(*by, *more, *(F.col(c).cast("double").alias(n) for c, n in zip([*source, *target], NAMES, strict=True)))
    fine = [F.col(b).isNotNull() for b in by] + [F.abs(n) < float("inf") for n in NAMES]
    for f in fine:
        rows = rows.where(f)
    return rows


def robust_similarity(pairs: DataFrame, by: list[str], source: tuple[str, str, str], target: tuple[str, str, str], threshold: float | str, hypotheses: int = HYPOTHESES, seed: int = 7) -> DataFrame:
    """(by, n, inliers, s, r, t): the similarity that moves most of a group's source points to within the threshold (a number or a column) of their targets.

    Of each group the rows that come first by a seeded hash are kept, three times as many as hypotheses, and each hypothesis
    draws three of them. A group's rows are packed into chunks of some CHUNK rows; a task solves all samples of a chunk's group at
    once and counts what is near to each in the chunk, and the best is refitted twice on its inliers, by sums, as long
    as they don't get fewer. So a group is never gathered, whatever its size, and no sample is a row of a join; the work is its rows times
    the hypotheses. Ties go to the earlier hypothesis. A group of fewer
    than three rows, or without a sample that gives a scale above zero, has 0 inliers and no model. Equal rows are one to the draw, not to the count.
    """
    spark = pairs.sparkSession
    pairs = pairs.withColumn("_limit", F.lit(float(threshold)) if isinstance(threshold, (int, float)) else F.col(threshold).cast("double"))
    rows = named(pairs, by, source, target, "_limit").withColumn("_limit", F.coalesce("_limit", F.lit(float("nan"))))  # nothing is near then
    path = new_path(spark)
    rows = checkpoint(rows, path)  # the caller's expressions are worked out once
    centre = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(n).alias(f"c_{n}") for n in NAMES))
    centre = checkpoint(centre)
    # about the means, so that sums of squares don't cancel
    rows = rows.join(centre, by).select(*by, "n", "_limit", *((F.col(n) - F.col(f"c_{n}")).alias(n) for n in NAMES))
    dealt = rows.withColumn("_chunk", F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("n") / CHUNK))).repartition(*by, "_chunk").sortWithinPartitions(*by)
    packed = checkpoint(_packed(dealt, by, [*NAMES, "_limit"], "_rows", CHUNK))
    order = Window.partitionBy(*by).orderBy("_h", *NAMES)
    ranked = rows.withColumn("_h", F.xxhash64(F.lit(seed), *NAMES)).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= 3 * hypotheses)
    pool = checkpoint(_packed(ranked.withColumn("_rank", F.col("_rank").cast("double")), by, [*NAMES, "_rank"], "_pool").where(F.size("_pool") >= 3 * WIDTH))
    remove(spark, path)
    draws = spark.range(hypotheses).select(F.col("id").cast("int").alias("h")).select("h", *(F.xxhash64(F.lit(seed), "h", F.lit(j)).alias(f"d{j}") for j in range(3)))
    hashes = np.array([r[1:] for r in sorted(draws.collect())], np.int64)
    with wide_rows(spark):
        counts = _per_chunk(packed.join(pool, by), by, lambda rows, pool: _scored(rows, pool, hashes), "h long, n long", _rows=WIDTH, _pool=WIDTH)
        counts = counts.groupBy(*by, "h").agg(F.sum("n").alias("inliers"))
        best = counts.groupBy(*by).agg(F.max(F.struct("inliers", (-F.col("h")).alias("_h"))).alias("_b")).select(*by, F.col("_b.inliers").alias("inliers"), F.array((-F.col("_b._h")).cast("double"), F.col("_b.inliers").cast("double")).alias("_best"))
        best = checkpoint(best)

        def model_of(pool: np.ndarray, best: np.ndarray) -> list[np.ndarray] | None:
            h, s, r, t = drawn(pool, hashes)
            k = np.flatnonzero(h == best[0, 0])
            return [best[:, 1].astype(np.int64), s[k], *r[k].reshape(-1, 9).T, *t[k].T]

        model = [F.col("s"), F.array(*(f"r{i}" for i in range(9))).alias("r"), F.array(*(f"t{i}" for i in range(3))).alias("t")]
        flat = "s double, " + ", ".join([*(f"r{i} double" for i in range(9)), *(f"t{i} double" for i in range(3))])
        best = checkpoint(_per_chunk(pool.join(best, by), by, model_of, f"inliers long, {flat}", _pool=WIDTH, _best=2).select(*by, "inliers", *model))
        going = best
        as_one = F.concat(F.array("s"), "r", "t").alias("_model")
        sums = [f"m_{a}" for a in NAMES] + [f"m_{a}_{b}" for i, a in enumerate(NAMES) for b in NAMES[i:]]
        for _ in range(2):
            near = _per_chunk(packed.join(going.select(*by, as_one), by), by, _sums, "n long, " + ", ".join(f"{c} double" for c in sums), _rows=WIDTH, _model=13)
            near = near.groupBy(*by).agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums)).where("n >= 3").select(*by, "n", *((F.col(c) / F.col("n")).alias(c) for c in sums))
            refit = checkpoint(solved(near, by).where("s > 0").select(*by, "s", "r", "t"))
            again = _per_chunk(packed.join(refit.select(*by, as_one), by), by, lambda rows, model: [np.array([len(_near(rows, model))])], "_n long", _rows=WIDTH, _model=13)
            again = again.groupBy(*by).agg(F.sum("_n").alias("_n")).where("_n > 0").join(refit, by).select(*by, "_n", *(F.col(c).alias(f"_{c}") for c in "srt"))
            better = F.col("_n") >= F.col("inliers")
            merged = checkpoint(going.join(again, by, "left").select(*by, F.when(better, F.col("_n")).otherwise(F.col("inliers")).alias("inliers"), *(F.when(better, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in "srt"), F.coalesce(better, F.lit(False)).alias("_on")))
            best = merged if best is going else best.join(merged.select(*by), by, "left_anti").unionByName(merged.drop("_on"))
            going = merged.where("_on").drop("_on")
            best = best.drop("_on") if "_on" in best.columns else best
    placed = centre.join(best, by, "left")
    shift = F.array(*(F.col("t")[i] + F.col(f"c_t{i}") - F.col("s") * (F.col("r")[3 * i] * F.col("c_s0") + F.col("r")[3 * i + 1] * F.col("c_s1") + F.col("r")[3 * i + 2] * F.col("c_s2")) for i in range(3)))
    return placed.select(*by, "n", F.coalesce("inliers", F.lit(0)).cast("long").alias("inliers"), "s", "r", F.when(F.col("s").isNotNull(), shift).alias("t"))

"""Trajectories against the truth: drift after an alignment on the start, and relative errors of pose pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.motion import vector_of
from cairn.operators import asof
from cairn.operators.positions import positions
from cairn.operators.similarity import NAMES, moments, named, off, solved
from cairn.session import checkpoint

#: Places along a run at which its error is told.
SHARES = (0.25, 0.5, 0.75, 0.9, 1.0)


def drift_report(poses: DataFrame, by: list[str], order: list[str], source: tuple[str, str, str], target: tuple[str, str, str], shares: tuple[float, ...] = SHARES) -> DataFrame:
    """(by, n, length, scale, errors, return_at, return_distance, return_error, ate, scales) of each group's run.

    The similarity that best moves the first quarter of the run (at least three poses) to its
    targets is applied to all of it: errors are those at the given shares, the return is the pose of the last
    quarter whose target is nearest to the first target (ties: the earlier), return_at its order columns. ate is the error of an
    alignment of the whole run, scales those of each quarter on its own (null where it has no pose). length is the targets' path.

    Rows with a null key or a coordinate that is not finite are left out. Positions are counted
    over ranges, alignments are sums: no task holds a run, however long. Rows that tie in order keep one order of their own.
    """
    rows = positions(named(poses, by, source, target, *order), by, [*order, *NAMES])
    at, size = F.col("position"), F.col("size")
    cut = lambda q: F.floor(size * q).cast("long")
    quarter = F.when(at < cut(0.25), 0).when(at < cut(0.5), 1).when(at < cut(0.75), 2).otherwise(3)
    start = at < F.greatest(F.lit(3), F.floor(size / 4))
    parts = rows.withColumn("part", F.explode(F.when(start, F.array(quarter, F.lit(4), F.lit(5))).otherwise(F.array(quarter, F.lit(5)))))
    fits = checkpoint(solved(parts.groupBy(*by, "part").agg(*moments()), [*by, "part"]))
    first = fits.where("part = 4").select(*by, *(F.col(c).alias(f"_{c}") for c in "srt"))
    # every pose's target with the one before it: one step of the path, joined by position, so a long run is many keys
    ahead = rows.select(*by, (at + 1).alias("position"), *(F.col(f"t{i}").alias(f"b{i}") for i in range(3)))
    steps = rows.join(ahead, [*by, "position"]).groupBy(*by).agg(F.sum(F.sqrt(sum(((F.col(f"t{i}") - F.col(f"b{i}")) ** 2 for i in (1, 2)), (F.col("t0") - F.col("b0")) ** 2))).alias("length"))
    home = rows.where(at == 0).select(*by, *(F.col(f"t{i}").alias(f"h{i}") for i in range(3)))
    told = rows.join(first, by).join(home, by).withColumn("error", F.sqrt(off(F.col("_s"), F.col("_r"), F.col("_t"))))
    away = F.sqrt(sum(((F.col(f"t{i}") - F.col(f"h{i}")) ** 2 for i in (1, 2)), (F.col("t0") - F.col("h0")) ** 2))
    place = lambda q: F.greatest(F.lit(0), F.least(size - 1, F.floor(size * q).cast("long") - 1))
    late = F.when(at >= cut(0.75), F.struct(away.alias("away"), "position"))
    found = told.groupBy(*by).agg(
        F.max("size").alias("n"),
        F.first("_s").alias("scale"),
        *(F.max(F.when(at == place(q), F.col("error"))).alias(f"e{i}") for i, q in enumerate(shares)),
        F.min_by(F.struct(*order, away.alias("_away"), "error"), late).alias("back"),
    )
    whole = fits.where("part = 5").select(*by, F.col("rms").alias("ate"))
    scales = fits.where("part < 4").groupBy(*by).agg(*(F.max(F.when(F.col("part") == i, F.col("s"))).alias(f"q{i}") for i in range(4)))
    return (
        found.join(whole, by)
        .join(scales, by)
        .join(steps, by, "left")
        .select(
            *by,
            "n",
            F.coalesce("length", F.lit(0.0)).alias("length"),
            "scale",
            F.array(*(F.col(f"e{i}") for i in range(len(shares)))).alias("errors"),
            F.struct(*(F.col(f"back.{c}").alias(c) for c in order)).alias("return_at"),
            F.col("back._away").alias("return_distance"),
            F.col("back.error").alias("return_error"),
            "ate",
            F.array(*(F.col(f"q{i}") for i in range(4))).alias("scales"),
        )
    )


def turned_back(r: Column, v: list[Column]) -> list[Column]:
    """r^T v."""
    return [r[i] * v[0] + r[3 + i] * v[1] + r[6 + i] * v[2] for i in range(3)]


def relative(r1: Column, r2: Column) -> Column:
    """r1^T r2, row-major."""
    return F.array(*(r1[i] * r2[j] + r1[3 + i] * r2[3 + j] + r1[6 + i] * r2[6 + j] for i in range(3) for j in range(3)))


def relative_errors(poses: DataFrame, by: list[str], time: str, step: float = 1.0, slack: float = 0.1, aligned: bool = True) -> DataFrame:
    """(by, pairs, translation, rotation): root mean square errors of the motion from each pose to the first one a step or more later, at most slack more.

    poses: (by, time, c, r, gc, gr): estimated and true centres and camera-to-world rotations, row-major. Estimated motions are scaled by the group's similarity to the truth if
    aligned; its turn and shift have no part in a motion told in the first pose's axes. Rotations are in degrees, from the
    quaternion, so small ones keep their digits. Poses with a null are left out; groups without a pair have no row.
    """
    poses = poses.select(*by, time, "c", "r", "gc", "gr").dropna()
    poses = poses.select(*by, F.col(time).cast("double").alias("_time"), F.struct("c", "r", "gc", "gr").alias("_pose"))
    later = poses.select(*by, "_time", "_pose")
    pairs = asof.forward(poses.withColumn("_due", F.col("_time") + step), later, by, "_due", "_time", ["_pose"], clamp=False, bucket=max(64 * step, 1e-9))
    pairs = pairs.where(F.col("right_time") - F.col("_due") <= slack)
    if aligned:
        ends = [F.col(f"_pose.{c}")[i].alias(f"{n}{i}") for c, n in (("c", "s"), ("gc", "t")) for i in range(3)]
        fits = solved(poses.select(*by, *ends).groupBy(*by).agg(*moments()), by).select(*by, "s")
        pairs = pairs.join(fits, by)
    else:
        pairs = pairs.withColumn("s", F.lit(1.0))
    a, b = F.col("_pose"), F.col("right__pose")
    moved = turned_back(a["r"], [F.col("s") * (b["c"][i] - a["c"][i]) for i in range(3)])
    true = turned_back(a["gr"], [b["gc"][i] - a["gc"][i] for i in range(3)])
    miss = sum(((m - t) * (m - t) for m, t in zip(moved[1:], true[1:], strict=True)), (moved[0] - true[0]) * (moved[0] - true[0]))
    turn = vector_of(relative(relative(a["r"], b["r"]), relative(a["gr"], b["gr"])))
    told = pairs.select(*by, miss.alias("_miss"), turn.alias("_turn"))
    square = F.col("_turn")[0] ** 2 + F.col("_turn")[1] ** 2 + F.col("_turn")[2] ** 2
    return told.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.sqrt(F.avg("_miss")).alias("translation"), F.degrees(F.sqrt(F.avg(square))).alias("rotation"))

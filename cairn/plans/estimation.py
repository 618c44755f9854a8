"""Queries that estimate: focal grids, two-view models, triangulation, robust alignment, drift, depth audits, neighbours, merges, scans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import motion as M
from cairn.functions import scalars as S
from cairn.operators import depths, focal, landmarks, loops, neighbours, scans, similarity, trajectories, triangulation, twoview
from cairn.operators.positions import positions
from cairn.plans.bindings import EVENTS_SQL, FEATURES_SQL, events, features
from cairn.plans.registry import query
from cairn.session import table

#: A small grid for the tables' few frames.
GRID = focal.Grid(min_hfov=40, max_hfov=100, hfov_step=15, min_k1=-0.1, max_k1=0.1, k1_step=0.1)
CAMERAS = 5


def _ladder_sql(table_name: str, keys: str, place: str, value: str, grid: tuple[float, ...]) -> str:
    """(keys, best): the least value's place on an even grid, refined by the parabola through its neighbours."""
    step = grid[1] - grid[0]
    return f"""SELECT {keys}, {grid[0]} + {step} * ({place} + CASE WHEN l - 2 * {value} + r > 0 THEN greatest(-1, least(1, (l - r) / (2 * (l - 2 * {value} + r)))) ELSE 0 END) AS best
    FROM (SELECT *, lag({value}) OVER (PARTITION BY {keys} ORDER BY {place}) AS l, lead({value}) OVER (PARTITION BY {keys} ORDER BY {place}) AS r, row_number() OVER (PARTITION BY {keys} ORDER BY {value}, {place}) AS first FROM {table_name}) WHERE first = 1"""


_E = [f"m{3 * r + c}" + ("" if r == c == 2 else " * f" if 2 in (r, c) else " * f * f") for r in range(3) for c in range(3)]
_MINORS = [f"(e{3 * r + c} * e{3 * s + d} - e{3 * r + d} * e{3 * s + c})" for r, s in ((0, 1), (0, 2), (1, 2)) for c, d in ((0, 1), (0, 2), (1, 2))]
_CROSS = [f"{x} * a{i}{c} - {y} * a{j}{c}" for (x, i), (y, j) in (((("t1", 2)), ("t2", 1)), (("t2", 0), ("t0", 2)), (("t0", 1), ("t1", 0))) for c in range(3)]


@query(
    f"""WITH {FEATURES_SQL}, g AS (SELECT row_id, list(s ORDER BY pos) AS g FROM (SELECT row_id, pos, avg(v) AS s FROM (SELECT row_id, unnest(descriptor[1:12]) AS v, unnest(range(12)) AS pos FROM features) GROUP BY row_id, pos) GROUP BY row_id),
k AS (SELECT row_id % {CAMERAS} AS camera, row_id, k, {GRID.k1s[0]} + k * 0.1 AS k1, g[1] AS t0, g[2] AS t1, g[3] AS t2, {", ".join(f"g[{4 + 3 * i + c}]" + (f" + {GRID.k1s[0]} + k * 0.1" if i == c else "") + f" AS a{i}{c}" for i in range(3) for c in range(3))} FROM g, (SELECT unnest(range(3)) AS k)),
m AS (SELECT camera, row_id, k, abs(k1 - t0) AS residual, {", ".join(f"{x} AS m{i}" for i, x in enumerate(_CROSS))} FROM k),
e AS (SELECT camera, row_id, k, h, residual, {", ".join(f"{x} AS e{i}" for i, x in enumerate(_E))} FROM (SELECT *, 0.5 / tan(radians({GRID.hfovs[0]} + 15 * h) / 2) AS f FROM m, (SELECT unnest(range(5)) AS h))),
s AS (SELECT camera, row_id, k, h, residual, {" + ".join(f"e{i} * e{i}" for i in range(9))} AS square, 2 * sqrt({" + ".join(f"{x} * {x}" for x in _MINORS)}) AS twice FROM e),
c AS (SELECT camera, row_id, k, h, residual, sqrt(greatest(square - twice, 0) / (square + twice)) AS cost FROM s),
used AS (SELECT camera, row_id FROM (SELECT *, dense_rank() OVER (PARTITION BY row_id ORDER BY residual, k) AS d FROM c) WHERE d = 1 GROUP BY camera, row_id HAVING max(cost) - min(cost) >= {GRID.min_curve_depth}),
mean AS (SELECT camera, k, h, count(*) AS pairs, avg(cost) AS cost FROM c JOIN used USING (camera, row_id) GROUP BY camera, k, h),
rms AS (SELECT camera, k, sqrt(avg(residual)) AS v FROM m GROUP BY camera, k),
best AS ({_ladder_sql("rms", "camera", "k", "v", GRID.k1s)}),
place AS (SELECT camera, best, greatest(0, least(2, (best + 0.1) / 0.1)) AS spot FROM best),
line AS (SELECT place.camera, best AS k1, a.h, (1 - spot + floor(spot)) * a.cost + (spot - floor(spot)) * b.cost AS v FROM place JOIN mean AS a ON a.camera = place.camera AND a.k = least(floor(spot), 2) JOIN mean AS b ON b.camera = place.camera AND b.k = least(floor(spot) + 1, 2) AND b.h = a.h),
found AS ({_ladder_sql("line", "camera, k1", "h", "v", GRID.hfovs)})
SELECT mean.camera, CAST(k AS INTEGER) AS k, CAST(h AS INTEGER) AS h, pairs, round(cost, 6) AS cost, round(k1, 5) AS k1, round(best, 4) AS hfov, round(320 / tan(radians(best) / 2), 3) AS focal FROM mean JOIN found USING (camera)"""
)
def focal_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean cost curves of each camera's matrices over distortions and fields of view, and where they are least."""
    f = features(spark, sf_dir).groupBy("row_id").agg(*(F.avg(F.col("descriptor")[i]).alias(f"g{i}") for i in range(12)))
    t = [F.col(f"g{i}") for i in range(3)]

    def matrix(k1: float) -> Column:
        a = [[F.col(f"g{3 + 3 * i + c}") + (k1 if i == c else 0.0) for c in range(3)] for i in range(3)]
        return F.array(*(x for i, j in ((1, 2), (2, 0), (0, 1)) for x in (t[i] * a[j][c] - t[j] * a[i][c] for c in range(3))))

    fits = f.select(F.pmod("row_id", F.lit(CAMERAS)).alias("camera"), F.lit("fitted").alias("status"), F.array(*(F.abs(k1 - t[0]) for k1 in GRID.k1s)).alias("residuals"), F.array(*map(matrix, GRID.k1s)).alias("matrices"))
    curves = focal.pair_curves(fits, GRID)
    costs, residuals = focal.grid_sums(curves, ["camera"]), focal.residual_sums(curves, ["camera"])
    best = focal.estimates(costs, residuals, ["camera"], 640, GRID).drop("pairs")
    return costs.join(best, "camera").select("camera", "k", "h", "pairs", F.round(F.col("cost") / F.col("pairs"), 6).alias("cost"), F.round("k1", 5).alias("k1"), F.round("hfov", 4).alias("hfov"), F.round("focal", 3).alias("focal"))


CAMERA = twoview.Camera(520, 515, 320, 240, 640, 480)


def _turn(angle: float) -> list[list[float]]:
    """A rotation about an axis that is not a coordinate's."""
    x, y, z = (v / 3 for v in (1.0, 2.0, 2.0))
    c, s = math.cos(angle), math.sin(angle)
    return [[c + x * x * (1 - c), x * y * (1 - c) - z * s, x * z * (1 - c) + y * s], [y * x * (1 - c) + z * s, c + y * y * (1 - c), y * z * (1 - c) - x * s], [z * x * (1 - c) - y * s, z * y * (1 - c) + x * s, c + z * z * (1 - c)]]


def _cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as points (x, y, z) spread over a box, by supplier."""
    part, order, line = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("long").alias("group"),
        (F.pmod(part * 7919 + line * 389, F.lit(1000)) / 250.0 - 2).alias("x"),
        (F.pmod(order * 104729 + part * 31, F.lit(1000)) / 333.0 - 1.5).alias("y"),
        (4 + F.pmod(part * 31 + line * 177 + order * 7, F.lit(500)) / 100.0).alias("z"),
        F.pmod(order * 13 + line * 7 + part, F.lit(10)).alias("kind"),
        F.pmod(part * 53 + line * 11, F.lit(997)).alias("u"),
        F.pmod(order * 29 + part * 3, F.lit(983)).alias("v"),
        F.pmod(order * 17 + line * 5, F.lit(991)).alias("w"),
    )


_CLOUD_SQL = """cloud AS (SELECT l_suppkey AS "group", (l_partkey * 7919 + l_linenumber * 389) % 1000 / 250.0 - 2 AS x, (l_orderkey * 104729 + l_partkey * 31) % 1000 / 333.0 - 1.5 AS y, 4 + (l_partkey * 31 + l_linenumber * 177 + l_orderkey * 7) % 500 / 100.0 AS z,
(l_orderkey * 13 + l_linenumber * 7 + l_partkey) % 10 AS kind, (l_partkey * 53 + l_linenumber * 11) % 997 AS u, (l_orderkey * 29 + l_partkey * 3) % 983 AS v, (l_orderkey * 17 + l_linenumber * 5) % 991 AS w FROM lineitem)"""


@query("SELECT l_suppkey AS first, CAST(l_suppkey + 1 AS BIGINT) AS second, count(*) AS matches, l_suppkey % 3 <> 0 AS dominated, l_suppkey % 3 = 0 AS eligible FROM lineitem GROUP BY l_suppkey")
def two_view_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of views of a box, of a plane and of a turn on the spot, a fifth of their matches wrong: only the first are eligible, the others a homography explains."""
    r, t = _turn(0.12), (0.9, 0.15, 0.1)
    kind = F.pmod("group", F.lit(3))
    c = _cloud(spark, sf_dir).withColumn("z", F.when(kind == 1, 6 + 0.2 * F.col("x") + 0.1 * F.col("y")).otherwise(F.col("z")))
    moved = [r[i][0] * F.col("x") + r[i][1] * F.col("y") + r[i][2] * F.col("z") + F.when(kind == 2, 0.0).otherwise(t[i]) for i in range(3)]
    seen = lambda p: (520 * p[0] / p[2] + 320, 515 * p[1] / p[2] + 240)
    wrong, noise = F.col("kind") < 2, (F.pmod(F.col("u") + F.col("v"), F.lit(7)) - 3) / 20.0
    (x1, y1), (x2, y2) = seen([F.col(a) for a in "xyz"]), seen(moved)
    ends = c.select(F.col("group").alias("first"), (F.col("group") + 1).alias("second"), x1.alias("x1"), y1.alias("y1"), F.when(wrong, F.pmod("u", F.lit(640)).cast("double")).otherwise(x2 + noise).alias("x2"), F.when(wrong, F.pmod("v", F.lit(480)).cast("double")).otherwise(y2 - noise).alias("y2"))
    return twoview.verify_two_views(ends, CAMERA).select("first", "second", "matches", F.array_contains("reasons", "homography_dominated").alias("dominated"), "eligible")


@query(
    """SELECT l_partkey AS landmark, count(DISTINCT l_orderkey) AS views, round(any_value(p_partkey % 17 / 4.0 - 2), 5) AS x, round(any_value(p_partkey % 13 / 4.0 - 1.5), 5) AS y, round(any_value(6 + p_size % 10 / 3.0), 5) AS z, count(DISTINCT l_orderkey) AS front
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) >= 5"""
)
def triangulated_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as points, seen by the orders that hold them: found again from their images in all of these."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("landmark"), F.col("l_orderkey").alias("frame")).distinct()
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("landmark"), (F.pmod("p_partkey", F.lit(17)) / 4.0 - 2).alias("px"), (F.pmod("p_partkey", F.lit(13)) / 4.0 - 1.5).alias("py"), (6 + F.pmod("p_size", F.lit(10)) / 3.0).alias("pz"))
    f = F.col("frame")
    angle = F.pmod(f, F.lit(50)) / 100.0
    c, s, zero, one = F.cos(angle), F.sin(angle), F.lit(0.0), F.lit(1.0)
    poses = lines.select("frame").distinct().select("frame", F.array(c, -s, zero, s, c, zero, zero, zero, one).alias("r"), F.array(F.pmod(f, F.lit(7)) / 5.0, F.pmod(f, F.lit(11)) / 7.0, F.pmod(f, F.lit(5)) / 10.0).alias("t"))
    at = lines.join(points, "landmark").join(poses, "frame")
    moved = [F.col("r")[3 * i] * F.col("px") + F.col("r")[3 * i + 1] * F.col("py") + F.col("r")[3 * i + 2] * F.col("pz") + F.col("t")[i] for i in range(3)]
    seen = at.select("landmark", "frame", (moved[0] / moved[2]).alias("x"), (moved[1] / moved[2]).alias("y"))
    found = triangulation.triangulate(seen, poses).where("views >= 5")
    checked = triangulation.reprojections(seen, poses, found).where("rms < 1e-9").select("landmark", "front")
    return found.join(checked, "landmark").select("landmark", "views", *(F.round(F.col(a), 5).alias(a) for a in "xyz"), "front")


_TURN = _turn(0.8)
_SHIFT = (3.0, -2.0, 5.0)
_MOVED_SQL = [f"(1.7 * ({_TURN[i][0]} * x + {_TURN[i][1]} * y + {_TURN[i][2]} * z) + {_SHIFT[i]})" for i in range(3)]
_TARGET_SQL = [f"CASE WHEN kind < 6 THEN {c} / 25.0 - 20 ELSE {m} END" for c, m in zip("uvw", _MOVED_SQL, strict=True)]


@query(
    f"""WITH {_CLOUD_SQL}, p AS (SELECT "group", {", ".join(f"{t} - {m} AS d{i}" for i, (t, m) in enumerate(zip(_TARGET_SQL, _MOVED_SQL, strict=True)))} FROM cloud)
SELECT "group", count(*) AS n, count(*) FILTER (WHERE d0 * d0 + d1 * d1 + d2 * d2 <= 0.0025) AS inliers, 1.7 AS scale, {", ".join(f"round({_TURN[i][j]}, 6) AS r{i}{j}" for i in range(3) for j in range(3))}, {", ".join(f"round({t}, 5) AS t{i}" for i, t in enumerate(_SHIFT))} FROM p GROUP BY "group" """
)
def robust_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A similarity for each supplier's points of which six in ten are elsewhere."""
    c = _cloud(spark, sf_dir)
    moved = [1.7 * (_TURN[i][0] * F.col("x") + _TURN[i][1] * F.col("y") + _TURN[i][2] * F.col("z")) + _SHIFT[i] for i in range(3)]
    pairs = c.select("group", "x", "y", "z", *(F.when(F.col("kind") < 6, F.col(a) / 25.0 - 20).otherwise(m).alias(f"to_{a}") for a, m in zip("uvw", moved, strict=True)))
    found = similarity.robust_similarity(pairs, ["group"], ("x", "y", "z"), ("to_u", "to_v", "to_w"), 0.05, hypotheses=256)
    return found.select("group", "n", "inliers", F.round("s", 6).alias("scale"), *(F.round(F.col("r")[3 * i + j], 6).alias(f"r{i}{j}") for i in range(3) for j in range(3)), *(F.round(F.col("t")[i], 5).alias(f"t{i}") for i in range(3)))


def _plane_fit_sql(source: str, keys: str) -> str:
    """(keys, n, s, and the rotation's or reflection's entries and the shift) of the least-squares similarity of the plane points (x, y) to (u, v): in space a plane may be turned over."""
    return f"""SELECT {keys}, n, s, CASE WHEN det >= 0 THEN cos(a) ELSE cos(b) END AS r00, CASE WHEN det >= 0 THEN -sin(a) ELSE sin(b) END AS r01, CASE WHEN det >= 0 THEN sin(a) ELSE sin(b) END AS r10, CASE WHEN det >= 0 THEN cos(a) ELSE -cos(b) END AS r11, mx, my, mu, mv, spread, tspread, gain
    FROM (SELECT *, CASE WHEN spread > 1e-18 THEN gain / spread ELSE 1.0 END AS s, atan2(c10 - c01, c00 + c11) AS a, atan2(c01 + c10, c00 - c11) AS b FROM (
    SELECT *, c00 * c11 - c01 * c10 AS det, sqrt(c00 * c00 + c01 * c01 + c10 * c10 + c11 * c11 + 2 * abs(c00 * c11 - c01 * c10)) AS gain FROM (
    SELECT {keys}, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, avg(u * x) - avg(u) * avg(x) AS c00, avg(u * y) - avg(u) * avg(y) AS c01, avg(v * x) - avg(v) * avg(x) AS c10, avg(v * y) - avg(v) * avg(y) AS c11,
    avg(x * x) - avg(x) * avg(x) + avg(y * y) - avg(y) * avg(y) AS spread, avg(u * u) - avg(u) * avg(u) + avg(v * v) - avg(v) * avg(v) AS tspread FROM {source} GROUP BY {keys})))"""


_RUN_SQL = f"""{EVENTS_SQL}, p AS (SELECT user_id, event_id, x, y, 1.7 * (0.8 * x - 0.6 * y) + d AS u, 1.7 * (0.6 * x + 0.8 * y) - 2 * d AS v, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n
    FROM (SELECT *, value AS x, event_id % 97 / 3.0 AS y, event_id % 13 / 10.0 AS d FROM timed))"""
_SHARES = trajectories.SHARES


@query(
    f"""WITH {_RUN_SQL}, fit AS ({_plane_fit_sql("(SELECT * FROM p WHERE pos < greatest(3, n // 4))", "user_id")}),
whole AS ({_plane_fit_sql("p", "user_id")}),
quarters AS ({_plane_fit_sql("(SELECT *, CASE WHEN pos < floor(n * 0.25) THEN 0 WHEN pos < floor(n * 0.5) THEN 1 WHEN pos < floor(n * 0.75) THEN 2 ELSE 3 END AS q FROM p)", "user_id, q")}),
told AS (SELECT p.*, f.s, sqrt((f.s * (r00 * (x - mx) + r01 * (y - my)) + mu - u) ** 2 + (f.s * (r10 * (x - mx) + r11 * (y - my)) + mv - v) ** 2) AS error, sqrt((u - hu) ** 2 + (v - hv) ** 2) AS away,
    sqrt((u - lag(u) OVER w) ** 2 + (v - lag(v) OVER w) ** 2) AS step FROM p JOIN fit AS f USING (user_id) JOIN (SELECT user_id, u AS hu, v AS hv FROM p WHERE pos = 0) USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT t.user_id, any_value(t.n) AS n, round(coalesce(sum(step), 0), 4) AS length, round(any_value(t.s), 6) AS scale, {", ".join(f"round(max(error) FILTER (WHERE pos = greatest(0, least(t.n - 1, floor(t.n * {q}) - 1))), 5) AS e{i}" for i, q in enumerate(_SHARES))},
arg_min(event_id, {{'a': away, 'p': pos}}) FILTER (WHERE pos >= floor(t.n * 0.75)) AS return_event, round(min(away) FILTER (WHERE pos >= floor(t.n * 0.75)), 5) AS return_distance, round(arg_min(error, {{'a': away, 'p': pos}}) FILTER (WHERE pos >= floor(t.n * 0.75)), 5) AS return_error,
round((SELECT sqrt(greatest(0, tspread + s * s * spread - 2 * s * gain)) FROM whole WHERE whole.user_id = t.user_id), 5) AS ate, {", ".join(f"round((SELECT s FROM quarters WHERE quarters.user_id = t.user_id AND q = {i}), 5) AS q{i}" for i in range(4))}
FROM told AS t GROUP BY t.user_id"""
)
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a run in the plane, aligned on its first quarter."""
    x, y, d = F.col("value"), F.pmod("event_id", F.lit(97)) / 3.0, F.pmod("event_id", F.lit(13)) / 10.0
    runs = events(spark, sf_dir).select("user_id", "t", "event_id", x.alias("x"), y.alias("y"), (1.7 * (0.8 * x - 0.6 * y) + d).alias("u"), (1.7 * (0.6 * x + 0.8 * y) - 2 * d).alias("v"), F.lit(0.0).alias("zero"))
    r = trajectories.drift_report(runs, ["user_id"], ["t", "event_id"], ("x", "y", "zero"), ("u", "v", "zero"))
    five = lambda c, name: F.round(c, 5).alias(name)
    return r.select("user_id", "n", F.round("length", 4).alias("length"), F.round("scale", 6).alias("scale"), *(five(F.col("errors")[i], f"e{i}") for i in range(len(_SHARES))), F.col("return_at.event_id").alias("return_event"), five("return_distance", "return_distance"), five("return_error", "return_error"), five("ate", "ate"), *(five(F.col("scales")[i], f"q{i}") for i in range(4)))


_POSED = "(SELECT user_id, event_id, t / 3600 AS h, event_id % 89 / 10.0 AS x, event_id % 83 / 10.0 AS y, 1.5 * (event_id % 89 / 10.0) + event_id % 11 / 100.0 AS u, 1.5 * (event_id % 83 / 10.0) AS v, value / 50 AS a, value / 50 + event_id % 7 / 1000.0 AS b FROM timed)"


@query(
    f"""WITH {EVENTS_SQL}, p AS {_POSED}, fit AS ({_plane_fit_sql("p", "user_id")}),
pairs AS (SELECT * FROM (SELECT i.user_id, i.a, i.b, j.a AS a2, j.b AS b2, j.x - i.x AS dx, j.y - i.y AS dy, j.u - i.u AS du, j.v - i.v AS dv, j.h - i.h - 1 AS late, row_number() OVER (PARTITION BY i.event_id ORDER BY j.h, j.x, j.y) AS n FROM p AS i JOIN p AS j ON i.user_id = j.user_id AND j.h >= i.h + 1) WHERE n = 1 AND late <= 2)
SELECT user_id, count(*) AS pairs, round(sqrt(avg((fit.s * (cos(a) * dx + sin(a) * dy) - (cos(b) * du + sin(b) * dv)) ** 2 + (fit.s * (cos(a) * dy - sin(a) * dx) - (cos(b) * dv - sin(b) * du)) ** 2)), 5) AS translation,
round(degrees(sqrt(avg((a2 - a - b2 + b) ** 2))), 6) AS rotation FROM pairs JOIN fit USING (user_id) GROUP BY user_id"""
)
def relative_pose_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motions over an hour against true ones: root mean square errors of shift, in the true scale, and turn."""
    x, y = F.pmod("event_id", F.lit(89)) / 10.0, F.pmod("event_id", F.lit(83)) / 10.0
    zero, one = F.lit(0.0), F.lit(1.0)
    yaw = lambda a: F.array(F.cos(a), -F.sin(a), zero, F.sin(a), F.cos(a), zero, zero, zero, one)
    a = F.col("value") / 50
    poses = events(spark, sf_dir).select("user_id", (F.col("t") / 3600).alias("h"), F.array(x, y, zero).alias("c"), yaw(a).alias("r"), F.array(1.5 * x + F.pmod("event_id", F.lit(11)) / 100.0, 1.5 * y, zero).alias("gc"), yaw(a + F.pmod("event_id", F.lit(7)) / 1000.0).alias("gr"))
    found = trajectories.relative_errors(poses, ["user_id"], "h", 1.0, 2.0)
    return found.select("user_id", "pairs", F.round("translation", 5).alias("translation"), F.round("rotation", 6).alias("rotation"))


_DEPTHS_SQL = "d AS (SELECT l_suppkey, CAST(l_extendedprice AS DOUBLE) / 1000 AS truth, 1 / (CAST(l_quantity AS DOUBLE) + CAST(l_tax AS DOUBLE)) AS rho, CAST(l_discount AS DOUBLE) * 2.7 + 0.0137 AS sigma, CASE WHEN l_linenumber <= 2 THEN 1 / (CAST(l_quantity AS DOUBLE) + 3) ELSE 0 END AS prior FROM lineitem)"


def _depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", *(F.col(c).cast("double").alias(c) for c in ("l_extendedprice", "l_quantity", "l_tax", "l_discount")))
    return d.select("l_suppkey", (F.col("l_extendedprice") / 1000).alias("truth"), (1 / (F.col("l_quantity") + F.col("l_tax"))).alias("rho"), (F.col("l_discount") * 2.7 + 0.0137).alias("sigma"), F.when(F.col("l_linenumber") <= 2, 1 / (F.col("l_quantity") + 3)).otherwise(0.0).alias("prior"))


@query(
    f"""WITH {_DEPTHS_SQL}, e AS (SELECT l_suppkey, -ln(rho) - ln(truth) AS e, sigma FROM d WHERE truth > 0), m AS (SELECT l_suppkey, quantile_cont(e, 0.5) AS scale FROM e GROUP BY l_suppkey HAVING count(*) >= 500),
f AS (SELECT abs(e - scale) AS error, sigma FROM e JOIN m USING (l_suppkey))
SELECT CAST(lim AS DOUBLE) AS sigma_limit, count(*) AS kept, round(count(*) / (SELECT count(*) FROM f), 6) AS coverage, round(quantile_cont(error, 0.5), 6) AS median_error, round(avg(CAST(error < 0.05 AS INT)), 6) AS within_5, round(avg(CAST(error < 0.1 AS INT)), 6) AS within_10, round(avg(CAST(error < ln(1.25) AS INT)), 6) AS within_25,
round(quantile_cont(error / sigma, 0.5) / {depths.MEDIAN_DEVIATION}, 5) AS calibration FROM f, (SELECT unnest([0.02, 0.05, 0.1, 0.2, 0.5]) AS lim) WHERE sigma < lim GROUP BY lim"""
)
def depth_by_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of log depth after one scale per frame, of the samples surer than each limit, and how well the claimed deviations are calibrated."""
    samples = _depths(spark, sf_dir).select("l_suppkey", "truth", "rho", (F.col("sigma") * F.col("rho") * F.col("sigma") * F.col("rho")).alias("variance"))
    found = depths.depth_by_limit(samples, ["l_suppkey"])
    return found.select("sigma_limit", "kept", *(F.round(c, 6).alias(c) for c in ("coverage", "median_error", "within_5", "within_10", "within_25")), F.round("calibration", 5).alias("calibration"))


@query(
    f"""WITH {_DEPTHS_SQL}, e AS (SELECT l_suppkey, -ln(rho) - ln(truth) AS e, sigma FROM d WHERE truth > 0), m AS (SELECT l_suppkey, quantile_cont(e, 0.5) AS scale FROM e GROUP BY l_suppkey HAVING count(*) >= 50),
q AS (SELECT l_suppkey, -ln(prior) - ln(truth) AS e FROM d WHERE prior > 0 AND truth > 0), pm AS (SELECT l_suppkey, quantile_cont(e, 0.5) AS scale FROM q GROUP BY l_suppkey HAVING count(*) >= 50),
p AS (SELECT l_suppkey, count(*) AS prior_n, quantile_cont(abs(e - scale), 0.5) AS prior_error FROM q JOIN pm USING (l_suppkey) GROUP BY l_suppkey)
SELECT e.l_suppkey, count(*) AS n, round(exp(any_value(scale)), 6) AS scale, round(quantile_cont(abs(e - scale), 0.5), 6) AS median_error, round(quantile_cont(abs(e - scale) / sigma, 0.5) / {depths.MEDIAN_DEVIATION}, 5) AS calibration, coalesce(any_value(prior_n), 0) AS prior_n, round(any_value(prior_error), 6) AS prior_error
FROM e JOIN m USING (l_suppkey) LEFT JOIN p USING (l_suppkey) GROUP BY e.l_suppkey"""
)
def keyframe_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each keyframe's depths against the truth and against what a prior would have given."""
    samples = _depths(spark, sf_dir).select("l_suppkey", "truth", "rho", (F.col("sigma") * F.col("rho")).alias("sigma"), "prior")
    found = depths.keyframe_audit(samples, ["l_suppkey"])
    return found.select("l_suppkey", "n", *(F.round(c, 6).alias(c) for c in ("scale", "median_error")), F.round("calibration", 5).alias("calibration"), "prior_n", F.round("prior_error", 6).alias("prior_error"))


_KEYFRAMES_SQL = """k AS (SELECT c_nationkey AS map, c_custkey AS id, c_custkey * 7919 % 1000 / 10.0 AS x, c_custkey * 104729 % 997 / 10.0 AS y, c_custkey * 31 % 991 / 10.0 AS z, c_custkey % 7 - 3.0 AS a, c_custkey % 11 - 5.0 AS b, c_custkey % 13 - 5.5 AS c, 1.0 + c_custkey % 29 AS depth FROM customer)"""


@query(
    f"""WITH {_KEYFRAMES_SQL}, edges AS (SELECT map, id AS i, id + id % 60 AS j FROM k), both_ways AS (SELECT map, i, j FROM edges UNION SELECT map, j, i FROM edges),
n AS (SELECT a.map, a.id, b.id AS neighbour, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) / a.depth AS distance, degrees(acos(greatest(-1, least(1, (a.a * b.a + a.b * b.b + a.c * b.c) / (sqrt(a.a * a.a + a.b * a.b + a.c * a.c) * sqrt(b.a * b.a + b.b * b.b + b.c * b.c)))))) AS angle FROM k AS a JOIN k AS b ON a.map = b.map AND abs(a.id - b.id) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY map, id ORDER BY distance, neighbour) AS rank FROM n WHERE distance <= 1.503 AND angle <= 50.003 AND NOT EXISTS (SELECT 1 FROM both_ways AS e WHERE e.map = n.map AND e.i = n.id AND e.j = n.neighbour))
SELECT map, id, neighbour, round(distance, 6) AS distance, round(angle, 4) AS angle, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def pose_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as keyframes of their nation's map: the ten nearest that look the same way and have no edge yet."""
    c = F.col("c_custkey")
    place = F.array(F.pmod(c * 7919, F.lit(1000)) / 10.0, F.pmod(c * 104729, F.lit(997)) / 10.0, F.pmod(c * 31, F.lit(991)) / 10.0)
    axis = F.array(F.pmod(c, F.lit(7)) - 3.0, F.pmod(c, F.lit(11)) - 5.0, F.pmod(c, F.lit(13)) - 5.5)
    k = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("map"), c.alias("id"), place.alias("centre"), axis.alias("axis"), (1.0 + F.pmod(c, F.lit(29))).alias("depth"))
    edges = k.select("map", F.col("id").alias("first"), (F.col("id") + F.pmod("id", F.lit(60))).alias("second"))
    found = neighbours.pose_neighbours(k, edges, ["map"], 1.503, 50.003)
    return found.select("map", "id", "neighbour", F.round("distance", 6).alias("distance"), F.round("angle", 4).alias("angle"), "rank")


@query(
    """WITH RECURSIVE links AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part WHERE p_partkey % 5 <> 0 AND p_size > 15), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT reach.a, l.b FROM reach JOIN both_ways AS l ON l.a = reach.b), component AS (SELECT a AS landmark, min(b) AS c FROM reach GROUP BY a),
counts AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey), members AS (SELECT landmark, c, coalesce(n, 0) AS n FROM component LEFT JOIN counts ON l_partkey = landmark),
heads AS (SELECT c, landmark AS survivor FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, landmark) AS r FROM members) WHERE r = 1), m AS (SELECT landmark, survivor, n FROM members JOIN heads USING (c)),
moved AS (SELECT survivor AS landmark, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY survivor, l_orderkey ORDER BY landmark <> survivor, n DESC, landmark, l_linenumber) AS r FROM lineitem JOIN m ON m.landmark = l_partkey) WHERE r = 1
UNION ALL SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT landmark FROM m))
SELECT landmark, count(*) AS sightings, CAST(sum(l_linenumber) AS BIGINT) AS lines, CAST(sum(l_orderkey) AS BIGINT) AS keyframes FROM moved GROUP BY landmark"""
)
def merged_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are linked become the one with most lines, with the lines of all; an order that holds several keeps one."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("landmark"), F.col("l_orderkey").alias("keyframe"), "l_linenumber")
    same = table(spark, sf_dir, "part").where("p_partkey % 5 <> 0 and p_size > 15").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    moved, _ = landmarks.merge_landmarks(lines, same)
    return moved.groupBy("landmark").agg(F.count(F.lit(1)).alias("sightings"), F.sum("l_linenumber").cast("long").alias("lines"), F.sum("keyframe").cast("long").alias("keyframes"))


@query(
    f"""WITH {EVENTS_SQL}, p AS (SELECT user_id, event_id, value, value > 50 AS adds, row_number() OVER w AS pos, count(*) FILTER (WHERE value > 50) OVER w AS seen FROM timed WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT a.event_id, a.user_id, round(coalesce(sum(0.1 * pow(0.9, a.seen - b.seen) * b.value), 0), 6) AS mean, round(1 - pow(0.9, any_value(a.seen)), 6) AS weight FROM p AS a LEFT JOIN p AS b ON b.user_id = a.user_id AND b.adds AND b.pos <= a.pos GROUP BY a.event_id, a.user_id"""
)
def decayed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponentially weighted sums along each user's events; the small ones leave them as they are."""
    rows = positions(events(spark, sf_dir).select("user_id", "t", "event_id", "value"), ["user_id"], ["t", "event_id"])
    adds = F.col("value") > 50
    steps = rows.select("user_id", "position", F.when(adds, 0.9).otherwise(1.0).alias("d"), F.array(F.when(adds, 0.1 * F.col("value")).otherwise(0.0), F.when(adds, 0.1).otherwise(0.0)).alias("v"))
    states = scans.affine_scan(steps, ["user_id"], "position")
    return rows.join(states, ["user_id", "position"]).select("event_id", "user_id", F.round(F.col("state")[0], 6).alias("mean"), F.round(F.col("state")[1], 6).alias("weight"))


@query(
    """WITH e AS (SELECT l_orderkey, l_linenumber, 1 + CAST(l_tax AS DOUBLE) AS s, CAST(l_discount AS DOUBLE) AS a, CAST(l_quantity AS DOUBLE) / 10 AS x, CAST(l_quantity AS DOUBLE) / 20 AS y FROM lineitem),
w AS (SELECT *, 1 / s * 1.01 AS s2, -a + 0.02 AS a2, -(cos(a) * x + sin(a) * y) / s + 0.03 AS x2, -(cos(a) * y - sin(a) * x) / s AS y2 FROM e)
SELECT l_orderkey, l_linenumber, round((a + a2) ** 2 / 0.01 + ((s * (cos(a) * x2 - sin(a) * y2) + x) ** 2 + (s * (sin(a) * x2 + cos(a) * y2) + y) ** 2) / 0.04 + ln(s * s2) ** 2 / 0.0025, 6) AS distance FROM w"""
)
def reciprocal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each similarity after its supposed way back is from nothing, in deviations."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.col(c).cast("double").alias(c) for c in ("l_tax", "l_discount", "l_quantity")))
    zero, a = F.lit(0.0), F.col("l_discount")
    s, t = 1 + F.col("l_tax"), F.array(F.col("l_quantity") / 10, F.col("l_quantity") / 20, zero)
    e = d.select("l_orderkey", "l_linenumber", s.alias("s"), M.rotation_of(zero, zero, a).alias("r"), t.alias("t"), M.rotation_of(zero, zero, -a + 0.02).alias("r2"))
    e = e.withColumn("back", M.inverse_similar(F.col("s"), F.col("r"), F.col("t")))
    own = F.array(*(F.lit((0.01 if i < 3 else 0.04 if i < 6 else 0.0025) if i == j else 0.0) for i in range(7) for j in range(7)))
    t2 = F.array(F.col("back.t")[0] + 0.03, F.col("back.t")[1], F.col("back.t")[2])
    distance = M.reciprocal_distance(F.col("s"), F.col("r"), F.col("t"), own, F.col("back.s") * 1.01, F.col("r2"), t2, F.array_repeat(F.lit(0.0), 49))
    return e.select("l_orderkey", "l_linenumber", F.round(distance, 6).alias("distance"))


_LOOP_SQL = """l AS (SELECT l_suppkey // 4 AS second, l_suppkey AS first, l_partkey * 7919 % 1000 / 250.0 - 2 AS x, l_orderkey * 104729 % 1000 / 333.0 - 1.5 AS y, (l_partkey * 31 + l_orderkey * 7) % 500 / 100.0 AS z, (l_orderkey * 13 + l_linenumber * 7 + l_partkey) % 10 AS kind FROM lineitem WHERE l_linenumber <= 1 + l_suppkey % 3)"""


@query(
    f"""WITH {_LOOP_SQL}, c AS (SELECT first, second, count(*) AS matches, count(*) FILTER (WHERE kind >= 2 + first % 4) AS inliers FROM l GROUP BY first, second HAVING count(*) >= 20),
r AS (SELECT *, row_number() OVER (PARTITION BY second ORDER BY inliers DESC, matches DESC, first) AS rank FROM c WHERE inliers >= 12) SELECT first, second, matches, inliers, 2.0 AS scale, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2"""
)
def loop_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as shortlisted pairs, up to half of whose matches are elsewhere: the two of each four that fit a similarity best."""
    part, order, line, first = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber").cast("long"), F.col("l_suppkey").cast("long")
    rows = table(spark, sf_dir, "lineitem").where(line <= 1 + F.pmod(first, F.lit(3)))
    rows = rows.select(F.floor(first / 4).alias("second"), first.alias("first"), (F.pmod(part * 7919, F.lit(1000)) / 250.0 - 2).alias("x"), (F.pmod(order * 104729, F.lit(1000)) / 333.0 - 1.5).alias("y"), (F.pmod(part * 31 + order * 7, F.lit(500)) / 100.0).alias("z"), F.pmod(order * 13 + line * 7 + part, F.lit(10)).alias("kind"), F.pmod(order * 29 + part * 3, F.lit(983)).alias("w"))
    wrong = F.col("kind") < 2 + F.pmod("first", F.lit(4))
    ends = rows.select("first", "second", "x", "y", "z", F.when(wrong, 40 + F.col("w") / 7.0).otherwise(1 - 2 * F.col("y")).alias("u"), F.when(wrong, F.pmod("w", F.lit(89)) / 3.0 - 90).otherwise(3 + 2 * F.col("x")).alias("v"), F.when(wrong, F.pmod("w", F.lit(71)) / 2.0).otherwise(2 * F.col("z") - 2).alias("q"))
    found = loops.loop_candidates(ends, ("x", "y", "z"), ("u", "v", "q"), 0.02, keep=2)
    return found.select("first", "second", "matches", "inliers", F.round("s", 6).alias("scale"), "rank")


@query(
    """WITH f AS (SELECT l_orderkey, l_partkey % 50 AS ref, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, string_agg(CAST(ref AS VARCHAR), ',' ORDER BY line, ref) AS refs, count(*) AS n FROM f GROUP BY l_orderkey"""
)
def ordered_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order refers to, each once, in the order in which it is first named; of one line the smaller first."""
    named = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.pmod("l_partkey", F.lit(50)).alias("ref")))).alias("all"))
    refs = F.array_distinct(F.transform("all", lambda x: x["ref"].cast("string")))
    return named.select("l_orderkey", F.array_join(refs, ",").alias("refs"), F.size(refs).cast("long").alias("n"))


@query("SELECT event_id, round(2 * 100 * (sqrt(1 + (value - 50) ** 2 / 100) - 1), 6) AS cost, round(1 / sqrt(1 + (value - 50) ** 2 / 100), 6) AS weight FROM events")
def soft_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smooth robust loss of each event's error and what the error counts under it."""
    square = (F.col("value") - 50) * (F.col("value") - 50)
    return table(spark, sf_dir, "events").select("event_id", F.round(S.soft_l1_cost(square, 10.0), 6).alias("cost"), F.round(S.soft_l1_weight(square, 10.0), 6).alias("weight"))


@query(
    """WITH f AS (SELECT l_orderkey, l_partkey AS track, min(l_linenumber) AS keypoint FROM lineitem GROUP BY 1, 2), solved AS (SELECT p_partkey FROM part WHERE p_size > 10), placed AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT l_orderkey, keypoint, track, p_size, round(p_retailprice, 2) AS price FROM f JOIN part ON p_partkey = track WHERE p_size > 10 AND l_orderkey NOT IN (SELECT o_orderkey FROM placed)"""
)
def registration_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each frame that has no pose yet, its keypoints whose track has a point in the map; a track's first keypoint in the frame stands for it."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_partkey").alias("track")).agg(F.min("l_linenumber").alias("keypoint"))
    points = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("track"), "p_size", F.round("p_retailprice", 2).alias("price"))
    placed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return lines.join(placed, "l_orderkey", "left_anti").join(points, "track").select("l_orderkey", "keypoint", "track", "p_size", "price")

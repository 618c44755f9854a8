"""Two-view models, the focal grid and its stream, triangulation, robust alignment: planted scenes and the batch against the stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import motion
from cairn.operators import focal, landmarks, neighbours, scans, similarity, trajectories, triangulation, twoview, voxels
from cairn.settings import Verification
from cairn.streaming import focal as focal_stream
from cairn.streaming import windows


def rotation(v):
    v = np.asarray(v, float)
    angle = np.linalg.norm(v)
    if angle == 0:
        return np.eye(3)
    x, y, z = v / angle
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


CAMERA = twoview.Camera(520, 515, 320, 240, 640, 480)


def pair(mode, n=250, noise=0.3, outliers=0.2, seed=3):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.uniform(-2, 2, (n, 2)), rng.uniform(4, 9, n)]
    if mode == "plane":
        x[:, 2] = 6 + 0.2 * x[:, 0]
    r, t = rotation([0.02, -0.1, 0.03]), np.array([0.8, 0.1, 0.05]) * (mode != "turn")
    pixels = lambda p: p[:, :2] / p[:, 2:] * (520, 515) + (320, 240)
    a, b = pixels(x) + rng.normal(size=(n, 2)) * noise, pixels(x @ r.T + t) + rng.normal(size=(n, 2)) * noise
    k = int(n * outliers)
    b[:k] = rng.uniform([0, 0], [640, 480], (k, 2))
    return a, b, r, t


def test_five_points_give_the_essential_matrix():
    a, b, r, t = pair("general", 40, 0, 0)
    want = twoview.unit((np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]]) @ r)[None])[0]
    stack = np.arange(40).reshape(8, 5)
    for at in stack:
        found = twoview.essentials(CAMERA.rays(a[at])[None], CAMERA.rays(b[at])[None])
        assert min(min(abs(m - want).max(), abs(m + want).max()) for m in found) < 1e-9
    assert len(twoview.essentials(CAMERA.rays(a[stack]), CAMERA.rays(b[stack]))) >= 8
    m = twoview.fundamentals(a[None], b[None])[0]
    assert abs(twoview.sampson(m[None], a, b)).max() < 1e-6 and abs(np.linalg.det(m)) < 1e-12


@pytest.mark.parametrize(("mode", "n"), [("general", 250), ("general", 2000), ("plane", 250), ("turn", 250), ("few", 7)])
def test_two_views_by_their_reasons(spark, mode, n):
    a, b, r, t = pair(mode, n)
    rows = [(4, 9, *map(float, p), *map(float, q)) for p, q in zip(a, b, strict=True)] + [(4, 9, float("nan"), 1.0, 1.0, 1.0), (4, 9, None, 1.0, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "first long, second long, x1 double, y1 double, x2 double, y2 double").repartition(3)
    (found,) = twoview.verify_two_views(table, CAMERA).collect()
    assert found.matches == n
    if mode == "general":
        assert found.eligible and found.reasons == [] and found.verified >= 0.78 * n and found.homography_fraction < 0.3
        assert abs(np.array(found.rotation).reshape(3, 3) - r).max() < 0.01
        assert abs(np.array(found.shift) - t / np.linalg.norm(t)).max() < 0.02
        assert found.seed_score == pytest.approx(found.triangulated * found.coverage * min(found.median_parallax, 15))
    elif mode == "few":
        assert found.reasons == ["insufficient_matches", "insufficient_positive_depth_parallax_support", "limited_spatial_coverage"] and found.f is None
    else:
        assert not found.eligible and "homography_dominated" in found.reasons and found.homography_fraction > 0.95 and found.seed_score == 0
        if mode == "turn":
            assert "insufficient_positive_depth_parallax_support" in found.reasons
    assert twoview.verify_two_views(table.limit(0), CAMERA).collect() == []


def test_rules_are_checked():
    for wrong in ({"max_homography": 0}, {"seed": -1}, {"min_coverage": 0}):
        with pytest.raises(ValueError):
            Verification(**wrong)
    assert Verification().min_parallax == 2.0 and Verification().min_coverage == 0.2


GRID = focal.Grid(min_hfov=40, max_hfov=110, hfov_step=2, min_k1=-0.24, max_k1=0.2, k1_step=0.04, min_common=40, min_inliers=30)
SEEN = "session long, frame long, kind string, track_id long, x double, y double"


def walk(session, frames, hfov, k1, n=160):
    """Observations of a camera of that field of view and distortion that moves and turns through a cloud of points."""
    rng, width, height = np.random.default_rng(session), 640, 480
    x = np.c_[rng.uniform(-3, 3, n), rng.uniform(-2, 2, n), rng.uniform(3, 9, n)]
    length, half, out = 0.5 * width / np.tan(np.radians(hfov) / 2), 0.25 * (width**2 + height**2), []
    for i in range(frames):
        r = rotation([0.3 * np.sin(i * 0.11), 0.4 * np.sin(i * 0.07) + 1e-9, 0.2 * np.cos(i * 0.05)])
        p = (x - [0.8 * np.sin(i * 0.06), 0.5 * np.cos(i * 0.09), 0.4 * np.sin(i * 0.04)]) @ r.T
        u = p[:, :2] / np.maximum(p[:, 2:], 0.5) * length
        size = np.minimum(np.linalg.norm(u, axis=1), 700)
        bent = size.copy()
        for _ in range(50):  # the image's radius d of an undistorted one: d / (1 + k1 d^2)
            bent = np.minimum(size * (1 + k1 * bent * bent / half), 2000)
        d = u * (bent / np.maximum(np.linalg.norm(u, axis=1), 1e-9))[:, None] + ((width - 1) / 2, (height - 1) / 2) + rng.normal(size=(n, 2)) * 0.05
        inside = (p[:, 2] > 0.5) & (d > 0).all(1) & (d[:, 0] < width) & (d[:, 1] < height)
        out += [(session, i, "frame", int(k), float(d[k, 0]), float(d[k, 1])) for k in np.flatnonzero(inside)]
    return out


def test_focal_grid_of_planted_cameras(spark):
    true = {1: (65, -0.12), 2: (80, 0.08)}
    seen = spark.createDataFrame([*walk(1, 60, *true[1]), *walk(2, 45, *true[2]), (1, 30, "restart", None, None, None), (1, 2, "frame", None, 1.0, 1.0), (None, 1, "frame", 1, 1.0, 1.0)], SEEN)
    fits = focal.pair_fits(focal_stream.session_pairs(seen, 640, GRID), 640, 480, GRID, ("session",))
    curves = focal.pair_curves(fits, GRID).persist()
    assert {r.session for r in curves.select("session").distinct().collect()} == {1, 2}
    for row in curves.where("matrices is not null").collect():
        assert np.allclose(np.array(row.curves), focal_stream.curves_of(row.matrices, GRID), atol=1e-9)
        for m, curve in zip(row.matrices, row.curves, strict=True):  # equal to a decomposition
            f = 0.5 / np.tan(np.radians(GRID.hfovs[7]) / 2)
            s = np.linalg.svd(np.diag([f, f, 1]) @ np.array(m).reshape(3, 3) @ np.diag([f, f, 1]), compute_uv=False)
            assert curve[7] == pytest.approx((s[0] - s[1]) / (s[0] + s[1]), abs=1e-7)
    for row in focal.estimates(focal.grid_sums(curves, ["session"]), focal.residual_sums(curves, ["session"]), ["session"], 640, GRID).collect():
        hfov, k1 = true[row.session]
        assert abs(row.hfov - hfov) < 1.5 and abs(row.k1 - k1) < 0.02 and row.focal == pytest.approx(320 / np.tan(np.radians(row.hfov) / 2))
    curves.unpersist()


@pytest.mark.parametrize("cuts", [(17,), (5, 30, 31)])
def test_focal_stream_gives_the_sums_of_the_batch(spark, tmp_path, cuts):
    rows = [*walk(1, 42, 65, -0.12), *walk(2, 25, 80, 0.08), (1, 30, "restart", None, None, None), (2, 8, "reset", None, None, None)]
    bounds = [-1, *(c - 1 for c in cuts), 10**6]
    for i, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        spark.createDataFrame([r for r in rows if low < r[1] <= high], SEEN).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        found = focal_stream.focal_stream(stream, 640, 480, GRID)
        query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(key)
    got = {(r.session, r.second): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    pairs = focal_stream.session_pairs(spark.createDataFrame(rows, SEEN), 640, GRID)
    curves = focal.pair_curves(focal.pair_fits(pairs, 640, 480, GRID, ("session",)), GRID).persist()
    want = {(r.session, r.second): (r.first, r.status) for r in curves.collect()}
    assert {k: (r.first, r.status) for k, r in got.items()} == want
    for session, since in ((1, -1), (2, 7)):  # a restart keeps the sums, a reset doesn't
        last = max((r for r in got.values() if r.session == session), key=lambda r: r.second)
        own = curves.where((F.col("session") == session) & (F.col("second") > since))
        sums = {(r.k, r.h): r for r in focal.grid_sums(own, []).collect()}
        assert last.used == max((r.pairs for r in sums.values()), default=0)
        if sums:
            assert np.allclose(np.array(last.costs).reshape(len(GRID.k1s), -1), [[sums[k, h].cost for h in range(len(GRID.hfovs))] for k in range(len(GRID.k1s))], atol=1e-9)
            (estimate,) = focal.estimates(focal.grid_sums(own, []), focal.residual_sums(own, []), [], 640, GRID).collect()
            assert (last.k1, last.hfov, last.focal) == pytest.approx((estimate.k1, estimate.hfov, estimate.focal), abs=1e-6)
    curves.unpersist()


def test_triangulation_from_all_views(spark):
    rng = np.random.default_rng(0)
    points = rng.uniform(-3, 3, (50, 3)) + [0, 0, 8]
    seen, poses = [], []
    for f in range(40):
        r, t = rotation([0.05 * np.sin(f), 0.3 * np.cos(f) + 1e-9, 0.1 * f / 40]), np.array([np.sin(f), np.cos(f * 0.7), 0.3 * np.sin(f * 0.3)])
        poses.append((f, r.ravel().tolist(), t.tolist()))
        y = points @ r.T + t
        seen += [(int(i), f, float(y[i, 0] / y[i, 2]), float(y[i, 1] / y[i, 2])) for i in range(50) if (i + f) % 3]
    seen += [(99, 0, 0.1, 0.1), (98, 0, None, 0.1), (97, 0, 0.1, 0.1), (97, 0, 0.1, 0.1), (96, 77, 0.1, 0.1), (None, 0, 0.1, 0.1)]
    views = spark.createDataFrame(seen, "landmark long, frame long, x double, y double").repartition(5)
    cameras = spark.createDataFrame(poses, "frame long, r array<double>, t array<double>")
    found = triangulation.triangulate(views, cameras)
    got = {r.landmark: r for r in found.collect()}
    assert set(got) == {*range(50), 99, 97} and got[99].x is None and got[97].z is None and got[97].views == 2
    assert max(np.abs(np.array([got[i].x, got[i].y, got[i].z]) - points[i]).max() for i in range(50)) < 1e-9
    for r in triangulation.reprojections(views, cameras, found).collect():
        assert r.front == r.views == got[r.landmark].views and r.rms < 1e-12 and 1 < r.parallax < 90
    assert triangulation.triangulate(views.limit(0), cameras).collect() == []


def test_robust_similarity_with_six_in_ten_elsewhere(spark):
    rng = np.random.default_rng(1)
    r, t, s = rotation([0.4, -0.7, 1.1]), np.array([3, -2, 5.0]), 2.3
    rows = []
    for group, n in ((1, 400), (2, 2000), (3, 2), (4, 30)):
        x = rng.normal(size=(n, 3)) * 4 + 100
        y = s * x @ r.T + t
        k = int(0.6 * n)
        y[:k] = rng.normal(size=(k, 3)) * 30
        rows += [(group, *map(float, a), *map(float, b)) for a, b in zip(x, y, strict=True)]
    rows += [(1, float("nan"), *[1.0] * 5), (None, *[1.0] * 6), *[(5, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0)] * 5]
    table = spark.createDataFrame(rows, "g long, a double, b double, c double, x double, y double, z double").repartition(3)
    got = {row.g: row for row in similarity.robust_similarity(table, ["g"], ("a", "b", "c"), ("x", "y", "z"), 0.05).collect()}
    assert {g: (row.n, row.inliers) for g, row in got.items()} == {1: (400, 160), 2: (2000, 800), 3: (2, 0), 4: (30, 12), 5: (5, 5)}
    assert got[3].s is None and got[5].s == 1  # points without extent are shifted
    for g in (1, 2, 4):
        assert got[g].s == pytest.approx(s, abs=1e-9) and np.allclose(np.array(got[g].r).reshape(3, 3), r, atol=1e-9) and np.allclose(got[g].t, t, atol=1e-6)


def test_similarity_algebra(spark):
    rng = np.random.default_rng(2)

    def log(r):
        a = np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1))
        return a / (2 * np.sin(a)) * np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])

    def adjoint(s, r, t):
        a = np.zeros((7, 7))
        a[:3, :3], a[3:6, 3:6], a[3:6, 6], a[6, 6] = r, s * r, -t, 1
        a[3:6, :3] = np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]]) @ r
        return a

    rows, want = [], []
    for _ in range(20):
        pairs = []
        for _ in range(2):
            m = rng.normal(size=(7, 7))
            pairs.append((float(rng.uniform(0.5, 2)), rotation(rng.normal(size=3)), rng.normal(size=3), m @ m.T + np.eye(7)))
        (s1, r1, t1, c1), (s2, r2, t2, c2) = pairs
        error = np.r_[log(r1 @ r2), s1 * r1 @ t2 + t1, np.log(s1 * s2)]
        a = adjoint(s1, r1, t1)
        rows.append([x if isinstance(x, float) else x.ravel().tolist() for p in pairs for x in p])
        want.append((error, a, error @ np.linalg.solve(c1 + a @ c2 @ a.T, error)))
    names = ["s1", "r1", "t1", "c1", "s2", "r2", "t2", "c2"]
    table = spark.createDataFrame(rows, ", ".join(f"{n} {'double' if n[0] == 's' else 'array<double>'}" for n in names)).coalesce(1)
    c = [F.col(n) for n in names]
    both = motion.compose_similar(c[0], c[1], c[2], c[4], c[5], c[6])
    back = motion.inverse_similar(c[0], c[1], c[2])
    home = motion.compose_similar(c[0], c[1], c[2], back["s"], back["r"], back["t"])
    found = table.select(motion.similar_error(both["s"], both["r"], both["t"]).alias("e"), motion.similar_adjoint(c[0], c[1], c[2]).alias("a"), motion.reciprocal_distance(*c).alias("d"), motion.similar_error(home["s"], home["r"], home["t"]).alias("none")).collect()
    for row, (error, a, distance) in zip(found, want, strict=True):
        assert np.allclose(row.e, error, atol=1e-9) and np.allclose(np.array(row.a).reshape(7, 7), a) and row.d == pytest.approx(distance, rel=1e-9) and np.allclose(row.none, 0, atol=1e-9)
    flat = spark.range(1).select(motion.squared_length(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0), F.lit(4.0)), 2).alias("d"))
    assert flat.first().d is None


def test_points_and_distances_are_worked_out_in_batches(spark):
    """No interpreted loop of expressions is left in either plan; missing numbers stay missing."""
    from cairn.functions import geometry, motion

    k = (-0.2, 0.05, 0.001, 0.002, 0.01)
    points = spark.createDataFrame([(0.3, 0.1), (-0.2, 0.25), (None, 0.1)], "x double, y double")
    back = points.select("x", "y", geometry.brown_distort(F.col("x"), F.col("y"), k).alias("d")).select("x", "y", motion.brown_undistort(F.col("d.x"), F.col("d.y"), k, 60).alias("u"))
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan
    for r in back.collect():
        assert r.x is None and r.u.x is None and r.u.y is None or abs(r.u.x - r.x) < 1e-12 and abs(r.u.y - r.y) < 1e-12
    one = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    still, unit = one(1, 0, 0, 0, 1, 0, 0, 0, 1), one(*(1.0 if i % 8 == 0 else 0.0 for i in range(49)))
    flat = F.array_repeat(F.lit(0.0), 49)
    moved = points.select(*(motion.reciprocal_distance(F.lit(1.0), still, F.array("x", "y", F.lit(0.0)), c, F.lit(1.0), still, one(0, 0, 0), flat).alias(n) for n, c in (("d", unit), ("none", flat))))
    assert "transform(" not in moved._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.d and round(r.d, 9), r.none) for r in moved.collect()] == [(0.1, None), (0.1025, None), (None, None)]


def test_robust_similarity_joins_no_samples(spark, monkeypatch):
    """No join makes a row for each sample of each row, and a group in many chunks gives the counts of one in a single chunk."""
    rng = np.random.default_rng(4)
    p = rng.normal(size=(900, 3))
    q = np.where((np.arange(900) % 10 < 6)[:, None], rng.normal(size=(900, 3)) * 5, 2 * p + 1)
    rows = spark.createDataFrame([(int(i % 2), *map(float, x), *map(float, y)) for i, (x, y) in enumerate(zip(p, q, strict=True))], "g int, a double, b double, c double, x double, y double, z double")
    seen, plain = [], similarity.checkpoint
    monkeypatch.setattr(similarity, "checkpoint", lambda df, *a: seen.append(plain(df, *a)) or seen[-1])
    ask = lambda: sorted((r.g, r.n, r.inliers, round(r.s, 6)) for r in similarity.robust_similarity(rows, ["g"], ("a", "b", "c"), ("x", "y", "z"), 0.01, hypotheses=64).collect())
    whole = ask()
    assert whole == [(0, 450, 180, 2.0), (1, 450, 180, 2.0)]
    assert not any("h" in made.columns for made in seen)  # samples and their counts were tables before
    monkeypatch.setattr(similarity, "CHUNK", 50)
    assert ask() == whole


def test_pose_neighbours(spark):
    rng = np.random.default_rng(4)
    frames = [(0, i, rng.uniform(-20, 20, 3).tolist(), rng.normal(size=3).tolist(), float(rng.uniform(0.3, 8))) for i in range(300)]
    edges = [(0, int(a), int(b)) for a, b in rng.integers(0, 300, (3000, 2))]
    known = {(a, b) for _, a, b in edges} | {(b, a) for _, a, b in edges}
    keyframes = spark.createDataFrame([*frames, (1, 1, [0.0] * 3, [0.0] * 3, 1.0), (1, 2, None, [1.0, 0.0, 0.0], 1.0), (1, 3, [0.0] * 3, [1.0, 0.0, 0.0], 0.0)], "map long, id long, centre array<double>, axis array<double>, depth double")
    graph = spark.createDataFrame(edges, "map long, first long, second long")
    want = []
    for _, i, c, a, depth in frames:
        near = []
        for _, j, d, b, _ in frames:
            away, angle = np.linalg.norm(np.subtract(c, d)) / depth, np.degrees(np.arccos(np.clip(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b), -1, 1)))
            if abs(i - j) >= 2 and away <= 1.5 and angle <= 50 and (i, j) not in known:
                near.append((away, j))
        want += [(i, rank, j) for rank, (_, j) in enumerate(sorted(near)[:4], 1)]
    assert sorted((r.id, r["rank"], r.neighbour) for r in neighbours.pose_neighbours(keyframes, graph, ["map"], keep=4).collect()) == sorted(want)


def test_motion_noise_is_the_recursion(spark):
    rng, rate, n = np.random.default_rng(5), 1 / 60, 700
    errors, steps = rng.normal(size=(n, 6)), np.where(rng.random(n) < 0.9, 1, 2)
    rows = [(1, i, errors[i].tolist(), int(steps[i])) for i in range(n)] + [(2, 0, errors[0].tolist(), 2), (2, 1, [1.0], 1), (None, 0, errors[0].tolist(), 1)]
    table = spark.createDataFrame(rows, "g long, i long, error array<double>, steps int").repartition(7)
    got = {(r.g, r.i): r for r in scans.motion_noise(table, ["g"], "i").collect()}
    first, second, w0, w1, before = np.zeros((6, 6)), np.zeros((6, 6)), 0.0, 0.0, None
    for i in range(n):
        if steps[i] == 1:
            first, w0 = (1 - rate) * first + rate * np.outer(errors[i], errors[i]), (1 - rate) * w0 + rate
            if before is not None:
                second, w1 = (1 - rate) * second + rate * np.outer(errors[i], before), (1 - rate) * w1 + rate
        before = errors[i] if steps[i] == 1 else None
        q = np.zeros((6, 6)) if w0 <= 0 else first / w0 + (0.75 / w1 * (second + second.T) if w1 > 0 else 0)
        values, vectors = np.linalg.eigh(q)
        assert np.allclose(np.array(got[1, i].noise).reshape(6, 6), vectors @ np.diag(np.maximum(values, 0)) @ vectors.T, atol=1e-12)
        assert got[1, i].weight0 == pytest.approx(w0) and got[1, i].weight1 == pytest.approx(w1)
    assert len(got) == n + 1 and got[2, 0].weight0 == 0 and set(got[2, 0].noise) == {0.0}


def test_scan_in_many_blocks(spark):
    rows = spark.range(20_000).selectExpr("id % 3 AS g", "id DIV 3 AS n", "0.5 + (id * 7 % 50) / 100.0D AS d", "array(cast(id % 11 AS double)) AS v")
    got = {(r.g, r.n): r.state[0] for r in scans.affine_scan(rows, ["g"], "n", block=16).collect()}
    for g in range(3):
        state = 0.0
        for n in range((20_000 - g + 2) // 3):
            i = 3 * n + g
            state = (0.5 + i * 7 % 50 / 100) * state + i % 11
            assert got[g, n] == pytest.approx(state, rel=1e-12)


def test_merged_landmarks(spark):
    seen = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 2, "c"), (2, 3, "d"), (2, 4, "e"), (3, 4, "f"), (3, 9, "g"), (5, 1, "h"), (5, 1, "h"), (None, 1, "x")], "landmark long, keyframe long, v string")
    same = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (None, 3), (2, 2)], "a long, b long")
    moved, merges = landmarks.merge_landmarks(seen, same)
    assert sorted(map(tuple, moved.collect())) == [(2, 1, "a"), (2, 2, "c"), (2, 3, "d"), (2, 4, "e"), (2, 9, "g"), (5, 1, "h"), (5, 1, "h")]
    assert sorted(map(tuple, merges.collect())) == [(1, 2, 2), (2, 2, 3), (3, 2, 2), (7, 7, 0), (8, 7, 0)]


def test_drift_and_relative_errors_in_space(spark):
    rng = np.random.default_rng(6)
    r, t, s = rotation([0.4, -0.7, 1.1]), np.array([3, -2, 5.0]), 2.3

    def fit(x, y):
        mx, my = x.mean(0), y.mean(0)
        u, d, v = np.linalg.svd((y - my).T @ (x - mx) / len(x))
        flip = np.diag([1, 1, np.sign(np.linalg.det(u @ v))])
        scale = np.trace(np.diag(d) @ flip) / ((x - mx) ** 2).sum() * len(x)
        return scale, u @ flip @ v, my - scale * u @ flip @ v @ mx

    rows, runs, poses = [], {}, []
    for group, n in ((1, 150), (2, 9)):
        x = np.cumsum(rng.normal(size=(n, 3)), 0)
        y = s * x @ r.T + t + np.cumsum(rng.normal(size=(n, 3)) * 0.05, 0)
        runs[group] = x, y
        rows += [(group, i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
        times = np.cumsum(rng.uniform(0.2, 0.4, n))
        turns = [(rotation(rng.normal(size=3)), rotation(rng.normal(size=3) * 0.01)) for _ in range(n)]
        poses.append((group, times, x, [a for a, _ in turns], y, [r @ a @ b for a, b in turns]))
    table = spark.createDataFrame([*rows, (1, 900, float("nan"), *[0.0] * 5)], "g long, i long, a double, b double, c double, x double, y double, z double").repartition(3)
    for row in trajectories.drift_report(table, ["g"], ["i"], ("a", "b", "c"), ("x", "y", "z")).collect():
        x, y = runs[row.g]
        n = len(x)
        scale, turn, shift = fit(x[: max(3, n // 4)], y[: max(3, n // 4)])
        errors = np.linalg.norm(scale * x @ turn.T + shift - y, axis=1)
        tail = int(0.75 * n)
        away = np.linalg.norm(y[tail:] - y[0], axis=1)
        whole = fit(x, y)
        assert row.n == n and row.scale == pytest.approx(scale) and row.length == pytest.approx(np.linalg.norm(np.diff(y, axis=0), axis=1).sum())
        assert row.errors == pytest.approx([errors[min(n - 1, int(q * n) - 1)] for q in (0.25, 0.5, 0.75, 0.9, 1)], abs=1e-9)
        assert row.return_at.i == tail + away.argmin() and row.return_distance == pytest.approx(away.min()) and row.return_error == pytest.approx(errors[tail + away.argmin()])
        assert row.ate == pytest.approx(np.sqrt(((whole[0] * x @ whole[1].T + whole[2] - y) ** 2).sum(1).mean()), abs=1e-7)
        assert row.scales == pytest.approx([fit(x[int(q * n) : int((q + 0.25) * n)], y[int(q * n) : int((q + 0.25) * n)])[0] for q in (0, 0.25, 0.5, 0.75)], rel=1e-6)
    posed = [(g, float(a), b.tolist(), c.ravel().tolist(), d.tolist(), e.ravel().tolist()) for g, *columns in poses for a, b, c, d, e in zip(*columns, strict=True)]
    found = {row.g: row for row in trajectories.relative_errors(spark.createDataFrame(posed, "g long, time double, c array<double>, r array<double>, gc array<double>, gr array<double>"), ["g"], "time", 1.0, 0.3).collect()}
    for g, times, x, turns, y, true in poses:
        scale = fit(x, y)[0]
        shifts, angles = [], []
        for i in range(len(times)):
            j = int(np.searchsorted(times, times[i] + 1.0))
            if j < len(times) and times[j] - times[i] - 1.0 <= 0.3:
                shifts.append(np.linalg.norm(scale * turns[i].T @ (x[j] - x[i]) - true[i].T @ (y[j] - y[i])))
                delta = (turns[i].T @ turns[j]).T @ (true[i].T @ true[j])
                angles.append(np.degrees(np.arccos(np.clip((np.trace(delta) - 1) / 2, -1, 1))))
        assert found[g].pairs == len(shifts)
        assert found[g].translation == pytest.approx(np.sqrt(np.mean(np.square(shifts)))) and found[g].rotation == pytest.approx(np.sqrt(np.mean(np.square(angles))), rel=1e-6)


@pytest.mark.parametrize("cuts", [2, 5])
def test_voxel_ray_stream_is_integrate(spark, tmp_path, cuts):
    rng = np.random.default_rng(7)
    rows = [(1, int(i >= 40), *rng.uniform(-3, 3, 6).tolist(), float(rng.uniform(0.5, 2))) for i in range(80)] + [(2, 3, *rng.uniform(-3, 3, 6).tolist(), 1.0) for _ in range(20)] + [(2, 3, float("nan"), *[0.0] * 5, 1.0)]
    schema = "session long, segment long, px double, py double, pz double, ox double, oy double, oz double, weight double"
    for part in np.array_split(np.arange(len(rows)), cuts):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        found = windows.voxel_ray_stream(stream, 0.5, 1.0)
        batches = []
        query = found.writeStream.foreachBatch(lambda df, n: batches.append((n, df.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(key)
    assert len(batches) == cuts
    last = {}
    for _, own in sorted(batches):
        last.update({(r.session, r.segment, r.ix, r.iy, r.iz): r for r in own})
    for session, segment in ((1, 1), (2, 3)):
        want = {(r.ix, r.iy, r.iz): r for r in voxels.integrate(spark.createDataFrame([r for r in rows if r[0] == session and r[1] == segment], schema), 0.5, 1.0).collect()}
        got = {k[2:]: r for k, r in last.items() if k[:2] == (session, segment)}
        assert set(got) == set(want)
        assert all((got[k].weight, got[k].distance, got[k].rays) == pytest.approx((want[k].weight, want[k].distance, want[k].rays)) for k in want)


def test_loop_candidates(spark):
    from cairn.operators import loops

    rng = np.random.default_rng(8)
    r, rows = rotation([0.2, 0.5, -0.3]), []
    for first, second, n, wrong in ((1, 10, 60, 0.5), (2, 10, 80, 0.5), (3, 10, 19, 0.0), (4, 11, 40, 0.8), (5, 12, 30, 0.0), (6, 12, 30, 0.0)):
        x = rng.normal(size=(n, 3))
        y = 1.5 * x @ r.T + [1, 2, 3]
        y[: int(wrong * n)] = rng.normal(size=(int(wrong * n), 3)) * 20 + 50
        rows += [(first, second, *map(float, a), *map(float, b)) for a, b in zip(x, y, strict=True)]
    table = spark.createDataFrame([*rows, (None, 10, *[0.0] * 6)], "first long, second long, a double, b double, c double, x double, y double, z double").repartition(3)
    found = {(row.first, row.second): row for row in loops.loop_candidates(table, ("a", "b", "c"), ("x", "y", "z"), 0.01).collect()}
    # too few matches, too few inliers, the better of two, and the smaller of equals
    assert {k: (row.matches, row.inliers) for k, row in found.items()} == {(2, 10): (80, 40), (5, 12): (30, 30)}
    assert found[2, 10].s == pytest.approx(1.5) and np.allclose(np.array(found[2, 10].r).reshape(3, 3), r)

"""The engine's operators against scalar versions and hand-made rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.functions import scalars as S
from cairn.functions import vectors as V
from cairn.operators import alignment, asof, components, paging, simjoin, tracks, voxels
from cairn.session import checkpoint
from cairn.streaming import tracker


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    row = one(spark, V.dot(a, b), V.norm(a), V.cosine(a, b), V.cosine(a, zero), V.distance(a, b), V.normalized(zero))
    assert row[0] == 24 and row[1] == 5 and row[2] == pytest.approx(0.96) and row[3] is None and row[4] == pytest.approx(math.sqrt(2)) and row[5] == [0.0, 0.0]


def test_length_bins(spark):
    def loop(n):
        if n <= 16:
            return n - 1
        edge, b = 32, 16
        while n > edge and b < 23:
            edge, b = edge * 2, b + 1
        return b

    got = {r.n: r.b for r in spark.range(1, 5000).select(F.col("id").alias("n"), S.track_length_bin(F.col("id")).alias("b")).collect()}
    assert all(got[n] == loop(n) for n in got)


def test_whole_nanoseconds(spark):
    rows = spark.createDataFrame([("1.5",), ("0.000000001",), ("0.0000000001",), ("-1",), ("x",), (None,), ("9223372036.854775807",), ("9223372036.854775808",), ("1.0000000000001",), ("1.50000000000000000000",), ("15e-1",), ("1e-10",), ("0.00000000000000",), ("1200e-2",)], "t string")
    assert [r[0] for r in rows.select(S.whole_nanoseconds(F.col("t"))).collect()] == [1_500_000_000, 1, None, None, None, None, (1 << 63) - 1, None, None, 1_500_000_000, 1_500_000_000, None, 0, 12_000_000_000]


def test_cursors(spark):
    rows = spark.createDataFrame([(7,)], "row_id long").withColumn("c", S.encode_cursor("frames", "row_id"))
    found = rows.select(S.decode_cursor(F.col("c"), "frames", "row_id long").alias("a"), S.decode_cursor(F.col("c"), "pairs", "row_id long").alias("b")).first()
    assert found.a.row_id == 7 and found.b is None


def test_slug(spark):
    rows = spark.createDataFrame([("My clip (1).mp4",), ("--a--",), ("x" * 60,)], "t string").select(S.slug(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["My-clip-1-mp4", "a", "x" * 48]


def test_quaternions(spark):
    rng = np.random.default_rng(0)
    rows = [tuple(map(float, q / np.linalg.norm(q) * (1 if q[0] >= 0 else -1))) for q in rng.normal(size=(50, 4))] + [(0.0, 1.0, 0.0, 0.0), (1.0, 0.0, 0.0, 0.0)]
    q = spark.createDataFrame(rows, "w double, x double, y double, z double")
    back = q.select("*", G.matrix_quaternion(G.quaternion_matrix(*(F.col(c) for c in "wxyz"))).alias("q")).collect()
    assert all(np.allclose(r.q, [r.w, r.x, r.y, r.z], atol=1e-9) for r in back)


def test_distortion_inverts(spark):
    row = one(spark, G.division_undistort(F.lit(0.3), F.lit(-0.2), -0.15).alias("u"))
    back = one(spark, G.division_distort(F.lit(row.u.x), F.lit(row.u.y), -0.15).alias("b")).b
    assert back.x == pytest.approx(0.3) and back.y == pytest.approx(-0.2)


def test_camera_centre(spark):
    r = F.array(*(F.lit(float(x)) for x in (0, -1, 0, 1, 0, 0, 0, 0, 1)))
    assert one(spark, G.camera_centre(r, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))))[0] == [-2.0, 1.0, -3.0]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)] + [(7, 7)]
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    frame = spark.createDataFrame([*edges, *edges[:20], (None, 3)], "src long, dst long")
    assert {r.node: r.component for r in components.connected_components(frame).collect()} == label
    assert components.connected_components(frame.limit(0)).count() == 0


def test_components_take_few_and_small_rounds(spark, monkeypatch):
    """Stars take no round, one edge between two stars few, and a round's plan has no join that another repeats."""
    made, plain = [], components.checkpoint

    def counted(df):
        made.append(df._jdf.queryExecution().sparkPlan().toString())
        return plain(df)

    monkeypatch.setattr(components, "checkpoint", counted)
    stars = [(i % 2, i) for i in range(2, 60)] + [(i, 100) for i in range(101, 120)]
    found = components.connected_components(spark.createDataFrame(stars, "src long, dst long"))
    assert {r.node: r.component for r in found.collect()} == {n: min(e) for e in stars for n in e}
    assert len(made) == 1
    joined = components.connected_components(spark.createDataFrame([*stars, (31, 110)], "src long, dst long"))
    assert {r.node: r.component for r in joined.collect()} == {n: 0 if n % 2 == 0 and n < 100 else 1 for e in stars for n in e}
    assert len(made) <= 5
    assert max(plan.count("Join") for plan in made) <= 3 and max(plan.count("FileScan") for plan in made) <= 6


def test_cosine_rules():
    match = simjoin.mutual_cosine(0.5)
    i, j, score, distance = match(np.array([[2.0, 0], [0, 3], [0, 0]]), np.array([[0.0, 7], [4, 0], [0, 0]]))
    assert list(zip(i, j, score, distance, strict=True)) == [(0, 1, 1.0, 2.0), (1, 0, 1.0, 4.0)]
    assert len(match(np.array([[1.0, 0], [1, 0]]), np.array([[1.0, 0]]))[0]) == 0  # exact ties
    assert len(match(np.zeros((2, 2)), np.ones((2, 2)))[0]) == 0


def test_ratio_rules():
    rng = np.random.default_rng(42)
    a = rng.normal(size=(30, 256))
    order = rng.permutation(30)
    i, j, _, _ = simjoin.mutual_ratio(0.8)(a, a[order])
    assert sorted(i) == list(range(30)) and all(order[j] == i)
    assert len(simjoin.mutual_ratio()(np.zeros((3, 8)), np.zeros((3, 8)))[0]) == 0
    assert len(simjoin.mutual_ratio()(a[:1], a)[0]) == 0


def test_match_frames_blocks(spark, sf):
    from cairn.plans.bindings import features

    f = features(spark, sf)
    rows = [simjoin.match_frames(f, simjoin.mutual_cosine(0.25), block=b).collect() for b in (2, 50)]
    assert sorted(rows[0]) == sorted(rows[1]) and len(rows[0]) > 0


def test_stacked_frames_match_as_single_ones():
    """A frame against a stack, ragged, with zero vectors and exact copies, gives the matches of its pairs, in few calls."""
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 9, 40)
    sizes[7] = 60
    row, feature = np.repeat(np.arange(40), sizes), np.concatenate([np.arange(n) for n in sizes])
    matrix = rng.normal(size=(len(row), 5))
    matrix[::11], matrix[5::13] = 0, matrix[3]
    for matcher in (simjoin.mutual_cosine(0.3), simjoin.mutual_cosine(-1), simjoin.mutual_ratio(0.9)):
        calls = []
        prepare, match = matcher.stacked
        matcher.stacked = simjoin.Stacked(prepare, lambda *a, match=match, calls=calls: calls.append(1) or match(*a))
        first, second = (simjoin._Block(row[part], feature[part], matrix[part], prepare) for part in (row < 20, row >= 20))
        for a, b in ((first, second), (first, first), (second, second)):
            got = [(*r[:2], a.feature[r[2]], b.feature[r[3]], round(r[4], 9), round(r[5], 6)) for p in simjoin.block_matches(a, b, matcher) for r in zip(*p, strict=True)]
            want = []
            for k, one in enumerate(a.ids):
                for x, other in enumerate(b.ids):
                    if one < other:
                        own, its = a.rows(k, k + 1), b.rows(x, x + 1)
                        want += [(one, other, a.feature[own][i], b.feature[its][j], round(s, 9), round(d, 6)) for i, j, s, d in zip(*matcher(a.matrix[own], b.matrix[its]), strict=True)]
            assert sorted(got) == sorted(want) and want
        assert len(calls) < 780 / 3


def test_edges_leave_a_block_in_batches(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "BATCH_ROWS", 50)
    parts = ((np.arange(7), np.arange(7.0)) for _ in range(30))
    sizes = [b.num_rows for b in simjoin._batches(parts, ["a", "b"])]
    assert sum(sizes) == 210 and max(sizes) < 60


def test_match_totals(spark, sf):
    from cairn.plans.bindings import features

    f = features(spark, sf)
    edges = simjoin.match_frames(f, simjoin.mutual_cosine(0.25)).groupBy("first", "second").agg(F.count(F.lit(1)).alias("matches"), F.round(F.sum("score"), 9).alias("score"))
    assert sorted(simjoin.match_totals(f, simjoin.mutual_cosine(0.25), block=3).withColumn("score", F.round("score", 9)).collect()) == sorted(edges.collect())


def test_association_golden(spark):
    nodes = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 2), (9, 3)], "node long, frame long")
    edges = spark.createDataFrame([(0, 2, 0.9), (2, 3, 0.8), (1, 3, 0.7), (0, 3, 0.6)], "left long, right long, score double")
    rows = {r.node: r for r in tracks.associate_tracks(nodes, edges).collect()}
    assert {n: r.track for n, r in rows.items()} == {0: 0, 2: 0, 3: 0, 1: 1, 9: 9}
    assert (rows[0].conflicts, rows[0].cycles, rows[0].merged) == (1, 1, 2)
    assert tracks.track_summary(tracks.associate_tracks(nodes, edges)).first().longest == 3
    assert tracks.track_summary(tracks.associate_tracks(nodes.limit(0), edges.limit(0))).first().longest == 0


def test_tracks_by_component_are_the_global_tracks(spark):
    rng = np.random.default_rng(3)
    frame_of = {n: int(n // 6) for n in range(120)}
    edges = [(int(a), int(b), float(s)) for (a, b), s in zip(rng.integers(0, 120, (160, 2)), rng.random(160).round(2), strict=True) if a < b and frame_of[int(a)] != frame_of[int(b)]]
    root, *_ = tracks.associate(pd.DataFrame(edges, columns=["left", "right", "score"]), frame_of)
    got = tracks.associate_tracks(spark.createDataFrame(list(frame_of.items()), "node long, frame long"), spark.createDataFrame(edges, "left long, right long, score double"))
    assert {r.node: r.track for r in got.collect()} == {n: root.get(n, n) for n in frame_of}
    assert got.groupBy("track", "frame").count().where("count > 1").count() == 0


def test_tracks_in_rounds_are_the_global_tracks(spark):
    """Components beyond a task's size are merged in rounds: the tracks and the counters are those of the one pass."""
    rng = np.random.default_rng(5)
    for n, size, count in ((60, 6, 200), (90, 3, 150), (120, 1, 140), (12, 2, 60)):
        frame_of = {i: i // size for i in range(n)}
        edges = [(int(a), int(b), float(s)) for (a, b), s in zip(rng.integers(0, n, (count, 2)), rng.random(count).round(1), strict=True)]
        edges = sorted({(a, b): (a, b, s) for a, b, s in edges if a < b and frame_of[a] != frame_of[b]}.values())
        root, merged, cycles, conflicts = tracks.associate(pd.DataFrame(edges, columns=["left", "right", "score"]), frame_of)
        nodes = spark.createDataFrame(list(frame_of.items()), "node long, frame long")
        got = tracks.associate_tracks(nodes, spark.createDataFrame(edges, "left long, right long, score double"), group_edges=0).collect()
        assert {r.node: r.track for r in got} == {i: root.get(i, i) for i in frame_of}
        sums = {r.merged: r for r in got}
        by = {(root.get(r.node, r.node)): r for r in got}
        assert len(got) == n and sums and by
        whole = tracks.associate_tracks(nodes, spark.createDataFrame(edges, "left long, right long, score double")).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, whole))


def test_a_component_of_many_edges_is_one_pass(spark, monkeypatch):
    """60,000 edges went to rounds before; the pass reads them in order and a node that is far from its root is found in few steps."""
    monkeypatch.setattr(tracks, "merge_in_rounds", None)
    rng = np.random.default_rng(6)
    left, right = rng.integers(0, 500, (2, 80_000))
    edges = pd.DataFrame({"left": np.minimum(left, right), "right": np.maximum(left, right), "score": rng.random(80_000)})
    edges = edges[edges["left"] // 5 != edges["right"] // 5].drop_duplicates(["left", "right"])
    assert len(edges) > 50_000
    got = tracks.associate_tracks(spark.range(500).select(F.col("id").alias("node"), F.floor(F.col("id") / 5).alias("frame")), spark.createDataFrame(edges)).collect()
    assert len(got) == 500 and len({(r.track, r.frame) for r in got}) == 500
    # the merges that the definition gives, by sets
    track, merged = {n: {n} for n in range(500)}, 0
    for a, b in edges.sort_values(["score", "left", "right"], ascending=[False, True, True])[["left", "right"]].itertuples(index=False):
        if track[a] is not track[b] and not {n // 5 for n in track[a]} & {n // 5 for n in track[b]}:
            track[a] |= track[b]
            merged += 1
            for n in track[a]:
                track[n] = track[a]
    assert {r.node: r.track for r in got} == {n: min(track[n]) for n in range(500)}
    assert {r.merged for r in got} == {merged}


def test_a_falling_chain_takes_few_rounds(spark, monkeypatch):
    """Each edge of the chain is only first once the one before it has merged; a second chain repeats a frame halfway."""
    n, calls = 1001, []
    plain = tracks.connected_components
    monkeypatch.setattr(tracks, "connected_components", lambda *a: calls.append(1) or plain(*a))
    frame_of = {i: i for i in range(n)} | {2000 + i: 2000 + i if i != 30 else 2010 for i in range(60)}
    edges = [(i, i + 1, 1 - i / 10_000) for i in range(n - 1)] + [(2000 + i, 2001 + i, 1 - i / 10_000) for i in range(10)]
    root, merged, cycles, conflicts = tracks.associate(pd.DataFrame(edges, columns=["left", "right", "score"]), frame_of)
    nodes = spark.createDataFrame(list(frame_of.items()), "node long, frame long")
    got = tracks.associate_tracks(nodes, spark.createDataFrame(edges, "left long, right long, score double"), group_edges=0).collect()
    assert {r.node: r.track for r in got} == {i: root.get(i, i) for i in frame_of}
    assert {(r.merged, r.conflicts) for r in got if r.node < n} == {(n - 1, 0)}
    assert len(calls) <= 20


def test_dense_ids(spark):
    rows = spark.createDataFrame([(v,) for v in (30, 10, 20, 10, 500)], "v long")
    assert sorted((r.v, r.d) for r in tracks.dense_ids(rows, "v", "d").collect()) == [(10, 0), (10, 0), (20, 1), (30, 2), (500, 3)]


def test_asof(spark):
    left = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 99.0)], "_row long, t double").withColumn("k", F.lit(1))
    right = spark.createDataFrame([(9.0, 1), (11.0, 2), (25.1, 3)], "t double, v long").withColumn("k", F.lit(1))
    assert [(r._row, r.right_v) for r in asof.nearest(left, right, ["k"], "t", "t", 5.0, ["v"]).collect()] == [(1, 1)]
    assert sorted((r._row, r.right_v) for r in asof.forward(left, right, ["k"], "t", "t", ["v"]).collect()) == [(1, 2), (2, 3), (3, 3)]


def test_paging(spark):
    rows = spark.createDataFrame([(a, b) for a in range(5) for b in range(4)], "a long, b long")
    assert [tuple(r) for r in paging.page(rows, ["a", "b"], (1, 2), 3).collect()] == [(1, 3), (2, 0), (2, 1), (2, 2)]
    with pytest.raises(ValueError, match="limit"):
        paging.page(rows, ["a"], None, 0)
    assert [r.a for r in paging.every_nth(rows.select("a").distinct(), "a", 2).orderBy("a").collect()] == [0, 2, 4]


def test_ray_cells():
    cells = voxels.ray_cells(np.array([0.05, 0.05, 0.05]), np.array([1.05, 0.05, 0.05]), 0.1, 0.25)
    assert [c[:3] for c in cells] == [(x, 0, 0) for x in range(8, 13)]
    assert [round(c[3], 6) for c in cells] == [0.2, 0.1, 0.0, -0.1, -0.2]
    assert voxels.ray_cells(np.zeros(3), np.zeros(3), 0.1, 0.2) == [] and voxels.ray_cells(np.zeros(3), np.full(3, np.nan), 0.1, 0.2) == []
    rng = np.random.default_rng(0)
    for _ in range(30):
        o, p = rng.normal(size=(2, 3))
        own = voxels.ray_cells(o, p, 0.2, 0.4)
        assert all(sum(abs(a - b) for a, b in zip(x[:3], y[:3], strict=True)) == 1 for x, y in zip(own, own[1:], strict=False))


def test_voxel_key(spark):
    ids = [F.lit(x) for x in (3, -5, 7, 1000)]
    assert one(spark, voxels.pack_key(*ids))[0] == ((((3 << 18) + (-5 + (1 << 17)) << 18) + 7 + (1 << 17)) << 18) + 1000 + (1 << 17)
    assert one(spark, voxels.pack_key(F.lit(3), F.lit(1 << 17), F.lit(0), F.lit(0)))[0] is None


def test_alignment(spark):
    rng = np.random.default_rng(0)
    source = rng.normal(size=(60, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    target = 2.5 * source @ q.T + [1, 2, 3] + 0.01 * rng.normal(size=(60, 3))
    rows = [(1, *map(float, [*a, *b])) for a, b in zip(source, target, strict=True)]
    got = alignment.align_groups(spark.createDataFrame(rows, "g long, a double, b double, c double, x double, y double, z double"), "g", ("a", "b", "c"), ("x", "y", "z")).first()
    # the same by descent from the planted similarity: scale, rotation vector and shift, by differences

    def residual(p):
        angle = np.linalg.norm(p[1:4])
        axis = p[1:4] / max(angle, 1e-300)
        turned = source @ q.T
        turned = turned * np.cos(angle) + np.cross(axis, turned) * np.sin(angle) + np.outer(turned @ axis, axis) * (1 - np.cos(angle))
        return (p[0] * turned + p[4:] - target).ravel()

    at = np.array([2.5, 0, 0, 0, 1, 2, 3.0])
    for _ in range(20):
        slopes = np.array([(residual(at + step) - residual(at - step)) / 2e-6 for step in 1e-6 * np.eye(7)]).T
        at = at - np.linalg.lstsq(slopes, residual(at), rcond=None)[0]
    assert got.scale == pytest.approx(at[0], rel=1e-6) and got.ate == pytest.approx(np.sqrt((residual(at) ** 2).sum() / 60), rel=1e-6)


E0, E1, E2 = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
GOLDEN = [(0, 0, 0, E0), (0, 0, 1, E1), (0, 1, 0, E0), (0, 1, 1, E2), (0, 2, 0, E0), (0, 2, 1, E1)]


def test_tracker_golden(spark):
    rows = spark.createDataFrame(GOLDEN, "session long, row_id long, feature_id long, descriptor array<double>")
    out = tracker.track_sessions(rows, min_similarity=0.9, min_margin=0.01, max_inactive=3)
    got = sorted((r.row_id, r.feature_id, r.landmark_id, r.state) for r in out.collect())
    assert got == [(0, 0, 0, "new"), (0, 1, 1, "new"), (1, 0, 0, "matched"), (1, 1, 2, "new"), (2, 0, 0, "matched"), (2, 1, 1, "matched")]
    marks = {r.landmark_id: (r.observations, r.first_row, r.last_row) for r in tracker.landmarks(out).collect()}
    assert marks == {0: (3, 0, 2), 1: (2, 0, 2), 2: (1, 1, 1)}


def test_tracker_assigns_one_to_one(spark):
    rows = spark.createDataFrame([(0, 0, 0, E0), (0, 1, 0, E0), (0, 1, 1, E0)], "session long, row_id long, feature_id long, descriptor array<double>")
    got = sorted((r.row_id, r.feature_id, r.landmark_id, r.state) for r in tracker.track_sessions(rows, min_similarity=0.9, min_margin=0.0).collect())
    assert got == [(0, 0, 0, "new"), (1, 0, 0, "matched"), (1, 1, 1, "new")]


def test_stream_is_the_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 5))
    rows = [(s, r, f, [float(x) for x in base[(f + s) % 6] + 0.05 * rng.normal(size=5)]) for s in range(2) for r in range(6) for f in range(3)]
    schema = "session long, row_id long, feature_id long, descriptor array<double>"
    table = spark.createDataFrame(rows, schema)
    options = {"min_similarity": 0.8, "min_margin": 0.0, "max_inactive": 2}
    for part in range(3):
        table.where(f"row_id div 2 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = tracker.track_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), **options)
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
    key = lambda r: (r.session, r.row_id, r.feature_id, r.landmark_id, r.state, round(r.similarity or -9, 9))
    assert sorted(map(key, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(key, tracker.track_sessions(table, **options).collect()))


def test_checkpoint_cuts_lineage(spark):
    cut = checkpoint(spark.range(5).withColumn("x", F.col("id") * 2))
    assert cut.count() == 5 and "Range" not in cut._jdf.queryExecution().optimizedPlan().toString()
    assert checkpoint(spark.range(0)).count() == 0


def test_propose_accept(spark):
    from cairn.operators.assignment import propose_accept

    rng = np.random.default_rng(4)
    rows = sorted({(0, int(a), int(b)): float(c) for a, b, c in zip(rng.integers(0, 12, 60), rng.integers(0, 15, 60), rng.random(60).round(2), strict=True)}.items())
    free_a, free_b, want = set(range(12)), set(range(15)), {}
    for n in range(4):
        offers = {}
        for a in free_a:
            own = [(c, b) for (_, x, b), c in rows if x == a and b in free_b]
            if own:
                c, b = min(own)
                offers.setdefault(b, []).append((c, a))
        for b, own in offers.items():
            want[min(own)[1]] = (b, n)
            free_a.discard(min(own)[1])
            free_b.discard(b)
    table = spark.createDataFrame([(*k, c) for k, c in rows], "f long, a_id long, b_id long, cost double")
    assert {r.a_id: (r.b_id, r["round"]) for r in propose_accept(table, ["f"]).collect()} == want
    assert propose_accept(table.limit(0), ["f"]).count() == 0


def test_two_view(spark):
    from cairn.operators.epipolar import verify_pairs

    rng = np.random.default_rng(123)
    points = np.c_[rng.uniform(-2, 2, 250), rng.uniform(-1.4, 1.4, 250), rng.uniform(5, 10, 250)]
    c, s = np.cos(0.05), np.sin(0.05)
    moved = points @ np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]).T + [0.6, 0.05, 0.1]
    a, b = (500 * p[:, :2] / p[:, 2:] + [320, 240] + 0.1 * rng.normal(size=(250, 2)) for p in (points, moved))
    b[:50] = rng.uniform(0, 480, (50, 2))
    rows = [(0, 1, *map(float, [*x, *y])) for x, y in zip(a, b, strict=True)] + [(0, 2, 1.0, 2.0, 3.0, 4.0)]
    got = {r.second: r for r in verify_pairs(spark.createDataFrame(rows, "first long, second long, x1 double, y1 double, x2 double, y2 double")).collect()}
    assert 195 <= got[1].inliers <= 210 and got[1].median_error < 0.2 and got[2].inliers == 0


def test_two_view_with_many_outliers(spark):
    """Half the matches are wrong: the sampling goes on until a clean sample is nearly sure."""
    from cairn.operators.epipolar import verify_pairs

    rng = np.random.default_rng(9)
    points = np.c_[rng.uniform(-2, 2, 120), rng.uniform(-1.4, 1.4, 120), rng.uniform(5, 10, 120)]
    c, s = np.cos(0.05), np.sin(0.05)
    moved = points @ np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]).T + [0.6, 0.05, 0.1]
    rows = []
    for pair in range(1, 5):
        a, b = (500 * p[:, :2] / p[:, 2:] + [320, 240] + 0.1 * rng.normal(size=(120, 2)) for p in (points, moved))
        b[:60] = rng.uniform(0, 480, (60, 2))
        rows += [(0, pair, *map(float, [*x, *y])) for x, y in zip(a, b, strict=True)]
    got = verify_pairs(spark.createDataFrame(rows, "first long, second long, x1 double, y1 double, x2 double, y2 double")).collect()
    assert all(r.inliers >= 57 for r in got)


def test_motion_pairs(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(40)], "k string, n long, x double")
    assert sorted((r.first, r.second) for r in alignment.motion_pairs(rows, "k", "n", "x", 5.0).collect()) == [(0, 5), (10, 15), (20, 25), (30, 35)]


def test_windows_over_streams(spark, tmp_path):
    from cairn.streaming import windows

    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id * 10 as int),0) as ts, id % 2 as k, id * 1.0 as v from range(12)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, df in (("tumble", windows.sliding_counts(stream, "ts", ["k"], "v", "1 hour")), ("gap", windows.session_counts(stream, "ts", ["k"], "30 minutes"))):
        query = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "tumble" else "append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert sorted((r.k, r.n, r.total) for r in spark.table("tumble").collect()) == [(0, 3, 6.0), (0, 3, 24.0), (1, 3, 9.0), (1, 3, 27.0)]


def test_compose(spark):
    a, b = G.yaw(F.lit(0.3)), G.yaw(F.lit(0.4))
    t = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    p = one(spark, G.compose(a, t, b, t).alias("p")).p
    assert np.allclose(p.r[:2], [math.cos(0.7), -math.sin(0.7)]) and np.allclose(p.t, [1 + math.cos(0.3) - 2 * math.sin(0.3), 2 + math.sin(0.3) + 2 * math.cos(0.3), 6])


def test_motions(spark):
    """The exponential against its series, and back; half turns; a motion and its inverse; similarities."""
    from cairn.functions import motion as M

    skew = lambda v: np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])

    def series(v):
        total, term = np.eye(3), np.eye(3)
        for n in range(1, 40):
            term = term @ skew(v) / n
            total = total + term
        return total

    vectors = [(0.0, 0.0, 0.0), (1e-9, 0.0, 2e-9), (0.3, -0.2, 0.9), (np.pi, 0.0, 0.0), (0.0, 2.0, -2.0)]
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(vectors)], "i long, x double, y double, z double")
    got = rows.select("i", M.rotation_of(F.col("x"), F.col("y"), F.col("z")).alias("r")).select("i", "r", M.vector_of(F.col("r")).alias("v"), M.inverse(F.col("r"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("b")).orderBy("i").collect()
    for v, row in zip(vectors, got, strict=True):
        r = np.array(row.r).reshape(3, 3)
        assert np.allclose(r, series(v), atol=1e-12)
        assert np.allclose(series(row.v), r, atol=1e-9)
        assert np.allclose(np.array(row.b.r).reshape(3, 3) @ r, np.eye(3), atol=1e-12) and np.allclose(np.array(row.b.r).reshape(3, 3) @ [1, 2, 3] + row.b.t, 0, atol=1e-12)
    third = rows.where("i = 2").select(M.rotation_of(F.col("x"), F.col("y"), F.col("z")).alias("r")).select(M.perturbed(F.col("r"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), [F.lit(0.0), F.lit(0.0), F.lit(0.1), F.lit(1.0), F.lit(2.0), F.lit(3.0)]).alias("p"), M.compose_similar(F.lit(2.0), F.col("r"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.lit(3.0), F.col("r"), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))).alias("s")).first()
    r, turn = series(vectors[2]), series((0, 0, 0.1))
    assert np.allclose(np.array(third.p.r).reshape(3, 3), turn @ r) and np.allclose(third.p.t, turn @ [1, 0, 0] + [1, 2, 3])
    assert third.s.s == 6 and np.allclose(np.array(third.s.r).reshape(3, 3), r @ r) and np.allclose(third.s.t, 2 * r @ [0, 1, 0] + [1, 0, 0])


def test_filters(spark):
    """Updates without a flow, without a state, of outliers either way; points behind the camera; half floats."""
    from cairn.functions import motion as M

    null, lit = F.lit(None).cast("double"), lambda x: F.lit(float(x))
    row = one(
        spark,
        M.updated(lit(10), lit(0.5), lit(0.5), lit(12), lit(1)).alias("a"),
        M.updated(lit(10), lit(0.5), lit(0), lit(12), lit(1)).alias("b"),
        M.fused(null, null, lit(2), lit(0.5)).alias("c"),
        M.fused(lit(1), lit(0.5), null, null).alias("d"),
        M.fused(lit(1), lit(0.01), lit(9), lit(0.5)).alias("e"),
        M.fused(lit(1), lit(0.5), lit(9), lit(0.01)).alias("f"),
        M.triangulated([lit(1), F.lit(float("nan"))], [lit(1)], [lit(0)], lit(5)).alias("g"),
        M.audited_depth(lit(1), lit(1), F.lit(float("inf"))).alias("h"),
        M.projected_variance(lit(1), lit(1), lit(-1), 500.0, 500.0, np.eye(6).tolist()).alias("i"),
        M.from_half_bytes(M.half_bytes(F.array(lit(0.1), lit(-2.5), lit(1e6)))).alias("j"),
    )
    assert (row.a.value, row.a.variance) == (11, 0.5) and (row.b.value, row.b.variance) == (12, 1)
    assert (row.c.value, row.c.variance) == (2, 0.5) and (row.d.value, row.d.variance) == (1, 0.5)
    assert (row.e.value, row.e.variance) == (1, 0.02) and (row.f.value, row.f.variance) == (9, 0.01)
    assert not row.g and not row.h and row.i is None
    assert row.j == [float(x) for x in np.array([0.1, -2.5, 1e6]).astype(np.float16)]


def test_settings():
    from cairn import settings

    assert settings.Tracking().options() == {"min_similarity": 0.8, "min_margin": 0.02, "max_inactive": 15}
    bad = [(settings.Extraction, {"stride": 0}), (settings.Extraction, {"detection_threshold": 2}), (settings.Tracking, {"min_similarity": -2}), (settings.Tracking, {"max_inactive": 0}), (settings.Verification, {"threshold": float("nan")}), (settings.Verification, {"min_parallax": 90}), (settings.Verification, {"min_inliers": 7}), (settings.Matching, {"ratio": 1.0}), (settings.Matching, {"min_track_length": 1})]
    for kind, values in bad:
        with pytest.raises(ValueError):
            kind(**values)


def test_quantiles(spark):
    """Against numpy: ties, one value, null keys, nulls left out, a group over many partitions."""
    from cairn.operators.quantiles import quantiles

    rng = np.random.default_rng(2)
    groups = {"a": rng.integers(0, 9, 500).tolist(), "b": [3.5], None: rng.normal(size=300).tolist(), "c": [None]}
    rows = [(k, None if v is None else float(v)) for k, own in groups.items() for v in own]
    got = {r.k: r for r in quantiles(spark.createDataFrame(rows, "k string, v double").repartition(7), ["k"], "v", (0.0, 0.37, 1.0), (0.9,)).collect()}
    assert set(got) == {"a", "b", None}
    for k, r in got.items():
        own = np.sort(groups[k])
        assert (r.n, r.q0, r.q2) == (len(own), own[0], own[-1]) and r.q1 == pytest.approx(np.quantile(own, 0.37)) and r.r0 == own[int(0.9 * (len(own) - 1) + 0.5)]
    assert quantiles(spark.createDataFrame([], "v double"), [], "v", (0.5,)).count() == 0

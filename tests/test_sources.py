"""Readers and stores on small files."""

import struct

import numpy as np
import pytest

from cairn.sources import sequences, stores


def test_rgb_manifest(spark, tmp_path):
    good = tmp_path / "a" / "rgb.txt"
    good.parent.mkdir()
    good.write_text("# comment\n\n1.000000000 rgb/a.png\n1.040000001 rgb/b c.png\n1.2 rgb/d.png\n")
    rows = sequences.checked(sequences.read_rgb_manifest(spark, str(good)))
    assert [(r.line_no, r.timestamp_ns, r.image) for r in rows.orderBy("line_no").collect()] == [(3, 10**9, "rgb/a.png"), (4, 1_040_000_001, "rgb/b c.png"), (5, 1_200_000_000, "rgb/d.png")]
    assert [(r.frame_index, r.timestamp_ns) for r in sequences.sequence_frames(rows, 2).collect()] == [(0, 0), (2, 200_000_000)]
    for bad, says in (("1.0 a\n1.0 b\n", "increase"), ("1.0\n", "image"), ("x a\n", "nanoseconds"), ("1.00000000001 a\n", "nanoseconds"), ("1.0 ../a\n", "outside")):
        (tmp_path / "bad.txt").write_text(bad)
        with pytest.raises(Exception, match=says):
            sequences.checked(sequences.read_rgb_manifest(spark, str(tmp_path / "bad.txt"))).collect()


def test_discovery(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for name in ("b.MP4", "a.mov", "x.txt", "s/rgb.txt"):
        (tmp_path / name).write_text("1.0 a\n")
    found = sequences.discover_sources(spark, str(tmp_path), recursive=True).collect()
    assert [(r.path.split("/")[-1], r.kind) for r in found] == [("a.mov", "video"), ("b.MP4", "video"), ("s", "sequence")]


def test_tracks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("# size 640 480\nframe_index,timestamp_ns,track_id,x,y,extra\n0,0,1,1.5,2.5,z\n1,40,1,2.5,3.5,z\n")
    tracks, sizes = sequences.read_tracks(spark, str(tmp_path / "t.csv"))
    assert [(r.frame_index, r.track_id, r.x, r.r) for r in tracks.collect()] == [(0, 1, 1.5, None), (1, 1, 2.5, None)]
    assert [(r.width, r.height) for r in sizes.collect()] == [(640, 480)]
    bad = sequences.time_problems(tracks.selectExpr("1 as k", "frame_index", "0L as timestamp_ns"), ["k"], "frame_index", "timestamp_ns")
    with pytest.raises(Exception, match="increase"):
        sequences.checked(bad).collect()


def test_trajectories_and_poses(spark, tmp_path):
    (tmp_path / "gt.txt").write_text("# t tx ty tz qx qy qz qw\n1.5 1 2 3 0 0 0 1\n")
    assert sequences.read_ground_truth(spark, str(tmp_path / "gt.txt")).first().rotation == [1.0, 0, 0, 0, 1, 0, 0, 0, 1]
    (tmp_path / "poses.txt").write_text("0 -1 0 5 1 0 0 6 0 0 1 7\n")
    (tmp_path / "times.txt").write_text("0.25\n")
    r = sequences.read_poses(spark, str(tmp_path / "poses.txt"), str(tmp_path / "times.txt")).first()
    assert (r.t, r.x, r.y, r.z) == (0.25, 5, 6, 7) and np.allclose([r.qw, r.qx, r.qy, r.qz], [0.5**0.5, 0, 0, 0.5**0.5])


def test_depth_dump(spark, tmp_path):
    planes = np.zeros((2, 3, 4), "<f4")
    planes[:, 1, 2] = 0.5, 0.25
    (tmp_path / "d.bin").write_bytes(struct.pack("<iiQ", 4, 3, 9) + planes.tobytes())
    assert [tuple(r) for r in sequences.read_depth_dumps(spark, str(tmp_path / "d.bin")).collect()] == [(9, 1, 2, 0.5, 0.25)]


def test_recent_sessions(spark, tmp_path):
    (tmp_path / "r").write_text('"a" "f1" "x"\n"b" "f2" "y"\n"a" "f3" "z"\nbroken\n')
    assert [(r.video, r.folder) for r in sequences.recent_sessions(spark, str(tmp_path / "r")).collect()] == [("a", "f3"), ("b", "f2")]


def test_append_and_upsert(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (2, "b", 1)], "k long, v string, n long")
    assert stores.append_new(rows, f"{tmp_path}/a", ["k"]) is not None
    stores.append_new(rows.unionByName(spark.createDataFrame([(3, "c", 1)], rows.schema)), f"{tmp_path}/a", ["k"])
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/a").collect()) == [1, 2, 3]
    stores.upsert(rows, f"{tmp_path}/u", ["k"], "n")
    stores.upsert(spark.createDataFrame([(2, "new", 2), (9, "z", 1)], rows.schema), f"{tmp_path}/u", ["k"], "n")
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/u").collect()) == [(1, "a"), (2, "new"), (9, "z")]


def test_publish(spark, tmp_path):
    made = stores.publish(spark, {"edges": spark.range(5)}, f"{tmp_path}/run", "matches", parents=["p"])
    assert stores.manifest(spark, f"{tmp_path}/run")["id"] == made["id"] and stores.verify(spark, f"{tmp_path}/run")
    with pytest.raises(FileExistsError):
        stores.publish(spark, {"edges": spark.range(5)}, f"{tmp_path}/run", "matches")
    spark.range(3).write.parquet(f"{tmp_path}/run/more")
    assert not stores.verify(spark, f"{tmp_path}/run")


def test_resume(spark):
    planned = spark.createDataFrame([(0, 1, "h"), (0, 2, "h"), (1, 2, "h")], "a long, b long, hash string")
    done = spark.createDataFrame([(0, 1, "h")], planned.schema)
    assert sorted((r.a, r.b) for r in stores.pending(planned, done, ["a", "b"], "hash").collect()) == [(0, 2), (1, 2)]
    with pytest.raises(Exception, match="another identity"):
        stores.pending(planned, spark.createDataFrame([(0, 1, "other")], planned.schema), ["a", "b"], "hash").collect()


def test_images_and_empty_manifests(spark, tmp_path):
    """An image that isn't there is a problem of its line, a manifest without lines an error; sources open by kind."""
    for name, lines in (("a", "# t\n1.0 rgb/1.png\n2.0 rgb/2.png\n"), ("b", "# nothing\n")):
        (tmp_path / name / "rgb").mkdir(parents=True)
        (tmp_path / name / "rgb.txt").write_text(lines)
    (tmp_path / "a/rgb/1.png").write_bytes(b"x")
    rows = sequences.with_images(sequences.read_rgb_manifest(spark, f"{tmp_path}/a/rgb.txt"), f"{tmp_path}/a/rgb").orderBy("line_no").collect()
    assert rows[0].problem is None and rows[1].problem.endswith(":3: the image is missing")
    assert [r.frame_index for r in sequences.open_source(spark, f"{tmp_path}/a").orderBy("frame_index").collect()] == [0, 1]
    with pytest.raises(Exception, match="is empty"):
        sequences.open_source(spark, f"{tmp_path}/b").collect()
    with pytest.raises(ValueError, match="decoded outside"):
        sequences.open_source(spark, f"{tmp_path}/c.mp4")


def test_phone_recordings(spark, tmp_path):
    (tmp_path / "pose.csv").write_text("0.0,1,2,3,1,0,0,0\n1.0,1,2,4,0.5,0.5,0.5,0.5\n")
    (tmp_path / "frames.csv").write_text("0.1,0\n0.2,1\n")
    poses = sequences.read_phone_poses(spark, f"{tmp_path}/pose.csv").orderBy("t").collect()
    assert poses[0][:] == (0.0, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0) and poses[1].qw == 0.5
    assert [tuple(r) for r in sequences.read_phone_frames(spark, f"{tmp_path}/frames.csv").orderBy("frame_index").collect()] == [(0, 0.1), (1, 0.2)]
    assert sequences.landscape(1080.0, 1082.0, 360.0, 640.0, 720) == (1082.0, 1080.0, 640.0, 360.0)


def test_stores_are_read_back(spark, tmp_path):
    import struct

    blob = lambda n, f: struct.pack(f"<{n}{f}", *([1.0] * n))
    rows = [(i, i * 10, i, 64, 48, 2, blob(4, "f"), blob(2, "f"), blob(6, "e"), "f16") for i in range(4)] + [(4, 40, 4, 64, 48, 3, blob(4, "f"), blob(2, "f"), blob(6, "e"), "f16"), (5, 50, 5, 64, 48, 2, blob(4, "f"), blob(2, "f"), blob(6, "e"), "f64")]
    path = f"{tmp_path}/store"
    spark.createDataFrame(rows, "frame_index long, timestamp_ns long, pts long, width int, height int, keypoint_count int, keypoints binary, scores binary, descriptors binary, descriptor_encoding string").write.parquet(path)
    plain = stores.read_frames(spark, path, descriptors=False)
    assert "descriptors" not in plain.columns and [r.frame_index for r in plain.collect()] == list(range(6))
    assert stores.has_frame(spark, path, 3) and not stores.has_frame(spark, path, 9)
    wanted = spark.createDataFrame([(10, 1, 64, 48), (20, 2, 64, 50), (40, 4, 64, 48), (50, 5, 64, 48), (60, 6, 64, 48)], "timestamp_ns long, pts long, width int, height int")
    found = {r.frame_index: r.problem for r in stores.cached_frames(spark.read.parquet(path), wanted, size=3).collect()}
    assert found == {1: None, 2: "another image size", 4: "sizes don't fit the count of features", 5: "unknown encoding of descriptors"}
    spark.createDataFrame([(1, 2, 5), (0, 1, 3)], "first long, second long, count long").write.parquet(f"{tmp_path}/pairs")
    assert [r.first for r in stores.read_pairs(spark, f"{tmp_path}/pairs").collect()] == [0, 1]
    assert stores.read_pairs(spark, f"{tmp_path}/pairs", (1, 2)).first()["count"] == 5


def test_publish_of_a_changing_source(spark, tmp_path):
    source, made = tmp_path / "source", lambda: {"t": spark.range(3)}
    source.mkdir()
    (source / "a").write_text("one")
    assert stores.publish_unchanged(spark, str(source), made, f"{tmp_path}/fine", "test")["kind"] == "test"

    def changing():
        (source / "b").write_text("two")
        return made()

    with pytest.raises(RuntimeError, match="changed"):
        stores.publish_unchanged(spark, str(source), changing, f"{tmp_path}/not", "test")
    assert not stores.exists(spark, f"{tmp_path}/not") and stores.verify(spark, f"{tmp_path}/fine")
    points = spark.createDataFrame([(1, 0.5, 1.0, 2.0, 10, 20, 30)], "point_id long, x double, y double, z double, r int, g int, b int")
    bundle = stores.publish_reconstruction(spark, spark.range(2), points, spark.range(5), f"{tmp_path}/bundle", metadata={"n": 1})
    assert bundle["metadata"] == {"n": 1} and spark.read.parquet(f"{tmp_path}/bundle/cloud").first().value == "0.5 1.0 2.0 10 20 30"
    stores.write_summary(spark.range(3), f"{tmp_path}/summary", ["id"], {"v": 5})
    assert spark.read.option("header", True).csv(f"{tmp_path}/summary/summary").count() == 3
    for n, text in ((1, '{"state": "done"}'), (2, "not json"), (3, '{"state": "running"}')):
        (tmp_path / f"jobs/{n}").mkdir(parents=True)
        (tmp_path / f"jobs/{n}/status.json").write_text(text)
    listed = stores.jobs(spark, f"{tmp_path}/jobs").collect()
    assert {r.status["state"] for r in listed} == {"done", "running"} and listed[0].modified >= listed[1].modified

"""Readers of image sequences, tracks, trajectories and depth, as declared-schema DataFrames.

Each takes any path or glob that Spark reads, so many sequences are one scan; ``source`` is
the file a row came from. Readers that check return a ``problem`` column, null where the
row is fine; ``checked`` turns the first problem into an error when the rows are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.geometry import matrix_quaternion, quaternion_matrix
from cairn.functions.scalars import whole_nanoseconds

#: Columns of the text formats.
TRACKS = "frame_index long, timestamp_ns long, track_id long, x float, y float, r int, g int, b int"
TRAJECTORY = "frame_index long, timestamp_ns long, segment long, keyframe long, cx double, cy double, cz double, qw double, qx double, qy double, qz double, predicted int, confidence double"
MAP_POINTS = "track_id long, segment int, x double, y double, z double, r int, g int, b int, has_color int, keyframe_observations int, first_frame long, last_frame long, local int, landmark_id long"
GROUND_TRUTH = "t double, x double, y double, z double, qx double, qy double, qz double, qw double"
KEYFRAME_DEPTH = "keyframe long, frame_index long, x int, y int, idepth double, sigma double, prior_idepth double"
GRAPH_EDGES = "i long, j long, frame_i long, frame_j long, fallback int, loop int, reciprocal double, s double, qw double, qx double, qy double, qz double, tx double, ty double, tz double, info_trace double"
VIDEO_SUFFIXES = ("mp4", "mov", "mkv", "avi", "webm", "m4v", "mpg", "mpeg", "ts")


def checked(df: DataFrame) -> DataFrame:
    """df without problem; the first row with one fails the job with its text."""
    fine = F.when(F.col("problem").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("problem")).cast("boolean"))
    return df.where(fine).drop("problem")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_no, line), numbered from 1; a file is one row first, as only it knows its line order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value")
    return whole.select("source", F.posexplode(F.split("value", "\r?\n"))).select("source", (F.col("pos") + 1).alias("line_no"), F.trim("col").alias("line"))


def read_rgb_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_no, timestamp_ns, image, problem) of rgb.txt manifests: "seconds image" per line, blank lines and # comments skipped.

    A problem is: not two fields, a time that is not whole nanoseconds from 0 below 2^63, a
    time not after the one before, or an image outside the manifest's folder.
    """
    rows = _lines(spark, path).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    fields = F.split("line", r"\s+", 2)
    rows = rows.withColumn("image", F.get(fields, F.lit(1))).withColumn("timestamp_ns", whole_nanoseconds(fields[0]))
    before = F.lag("timestamp_ns").over(Window.partitionBy("source").orderBy("line_no"))
    outside = F.col("image").startswith("/") | F.array_contains(F.split("image", "/"), "..")
    problem = (
        F.when(F.col("image").isNull(), "expected a time and an image")
        .when(F.col("timestamp_ns").isNull(), "the time is not whole nanoseconds from 0 below 2^63")
        .when(before >= F.col("timestamp_ns"), "times must increase")
        .when(outside, "the image is outside the sequence")
    )
    return rows.withColumn("problem", F.when(problem.isNotNull(), F.concat("source", F.lit(":"), F.col("line_no").cast("string"), F.lit(": "), problem))).drop("line")


def sequence_frames(manifest: DataFrame, stride: int = 1) -> DataFrame:
    """(source, frame_index, timestamp_ns, image): every stride-th image, times from the first one's."""
    w = Window.partitionBy("source").orderBy("line_no")
    rows = manifest.withColumn("frame_index", (F.row_number().over(w) - 1).cast("long")).withColumn("first", F.first("timestamp_ns").over(w))
    return rows.where(F.pmod("frame_index", F.lit(stride)) == 0).select("source", "frame_index", (F.col("timestamp_ns") - F.col("first")).alias("timestamp_ns"), "image")


def time_problems(frames: DataFrame, by: list[str], order: str, time: str) -> DataFrame:
    """frames with problem where time is missing or not after the frame before."""
    before = F.lag(time).over(Window.partitionBy(*by).orderBy(order))
    return frames.withColumn("problem", F.when(F.col(time).isNull(), "a frame has no time").when(before >= F.col(time), "times must increase"))


def discover_sources(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, kind) of the videos and image sequences below a folder, in order; only names are read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(suffix.isin(*VIDEO_SUFFIXES), "video").when(F.element_at(F.split("path", "/"), -1) == "rgb.txt", "sequence")
    return listed.select(F.when(kind == "sequence", F.regexp_replace("path", "/rgb.txt$", "")).otherwise(F.col("path")).alias("path"), kind.alias("kind")).where("kind is not null").orderBy("path")


def _csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    return spark.read.schema(schema).options(header=True, enforceSchema=False, mode="FAILFAST", **options).csv(path)


def read_tracks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tracks, sizes) of tracks CSV: columns by name, r, g and b optional, others ignored; "# size W H" lines give (source, width, height)."""
    header = spark.read.option("header", True).option("comment", "#").csv(path).columns
    wanted = [f.split() for f in TRACKS.split(", ")]
    rows = spark.read.option("header", True).option("comment", "#").csv(path)
    tracks = rows.select(*(F.col(n).cast(t).alias(n) if n in header else F.lit(None).cast(t).alias(n) for n, t in wanted), F.input_file_name().alias("source"))
    size = F.split("value", r"\s+")
    sizes = spark.read.text(path).where(F.col("value").startswith("# size")).select(F.input_file_name().alias("source"), size[2].cast("int").alias("width"), size[3].cast("int").alias("height"))
    return tracks, sizes


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """TUM ground truth with its rotation, row-major."""
    rows = spark.read.schema(GROUND_TRUTH).options(sep=" ", comment="#").csv(path)
    return rows.withColumn("rotation", quaternion_matrix(*(F.col(c) for c in ("qw", "qx", "qy", "qz"))))


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, TRAJECTORY)


def read_map_points(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, MAP_POINTS)


def read_frame_times(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, "frame_index long, timestamp_ns long")


def read_keyframe_depth(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, KEYFRAME_DEPTH)


def read_graph_edges(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, GRAPH_EDGES)


def read_poses(spark: SparkSession, path: str, times: str) -> DataFrame:
    """KITTI poses, twelve numbers a line, with their times: (frame_index, t, x, y, z, qw, qx, qy, qz)."""
    numbers = F.transform(F.split("line", r"\s+"), lambda x: x.cast("double"))
    poses = _lines(spark, path).where("line <> ''").select("line_no", numbers.alias("m"))
    stamped = poses.join(_lines(spark, times).where("line <> ''").select("line_no", F.col("line").cast("double").alias("t")), "line_no")
    rotation = F.array(*(F.col("m")[i] for i in (0, 1, 2, 4, 5, 6, 8, 9, 10)))
    q = stamped.withColumn("q", matrix_quaternion(rotation))
    return q.select((F.col("line_no") - 1).cast("long").alias("frame_index"), "t", *(F.col("m")[i].alias(n) for i, n in ((3, "x"), (7, "y"), (11, "z"))), *(F.col("q")[i].alias(n) for i, n in enumerate(("qw", "qx", "qy", "qz"))))


def read_depth_dumps(spark: SparkSession, path: str) -> DataFrame:
    """(frame, y, x, rho, variance) of depth dumps: two 32-bit sizes, a 64-bit frame number, then two planes of 32-bit floats; only positive depths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                data = raw.as_py()
                width, height = np.frombuffer(data, "<i4", 2)
                frame = int(np.frombuffer(data, "<u8", 1, 8)[0])
                planes = np.frombuffer(data, "<f4", 2 * width * height, 16).reshape(2, height, width)
                y, x = np.nonzero(planes[0] > 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), frame)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(planes[0][y, x]), pa.array(planes[1][y, x])], names=["frame", "y", "x", "rho", "variance"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "frame long, y int, x int, rho float, variance float")


def recent_sessions(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """The latest line of each video in a list of quoted (video, folder, label) lines, latest first."""
    rows = _lines(spark, path).where("line <> ''").select("line_no", F.regexp_extract_all("line", F.lit('"([^"]*)"'), F.lit(1)).alias("f")).where("size(f) = 3")
    named = rows.select("line_no", *(F.col("f")[i].alias(n) for i, n in enumerate(("video", "folder", "label"))))
    latest = named.groupBy("video").agg(F.max(F.struct("line_no", "folder", "label")).alias("m"))
    return latest.select("video", "m.folder", "m.label", "m.line_no").orderBy(F.desc("line_no")).limit(limit)


def pixel_in_range(x: Column, y: Column, width: Column, height: Column) -> Column:
    return (x >= 0) & (y >= 0) & (x < width) & (y < height)


def with_images(manifest: DataFrame, path: str) -> DataFrame:
    """A manifest's rows with the problem of an image that isn't there; only names are listed. path covers the images."""
    spark = manifest.sparkSession
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("_found")).distinct()
    where = F.concat(F.regexp_replace("source", "[^/]*$", ""), F.col("image"))
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^[a-z]+:/*", "/"), "/+", "/")
    rows = manifest.withColumn("_image", plain(where)).join(listed.select(plain(F.col("_found")).alias("_image"), F.lit(True).alias("_there")), "_image", "left")
    missing = F.when(F.col("_there").isNull(), F.concat("source", F.lit(":"), F.col("line_no").cast("string"), F.lit(": the image is missing")))
    return rows.withColumn("problem", F.coalesce("problem", missing)).drop("_image", "_there")


def not_empty(rows: DataFrame, what: str) -> DataFrame:
    """rows; if there are none, reading them is an error that says what is empty."""
    none = rows.agg(F.count(F.lit(1)).alias("n")).where(F.when(F.col("n") == 0, F.raise_error(F.lit(f"{what} is empty")).cast("boolean")).otherwise(False))
    return rows.unionByName(none.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields)))


#: The reader of each kind of source, by its suffix.
READERS = {"csv": read_tracks, "txt": read_ground_truth}


def open_source(spark: SparkSession, path: str):
    """What a path holds, by its kind: the frames of a folder with a manifest, the tracks of a CSV, the poses of a text file."""
    suffix = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if "." not in path.rstrip("/").rsplit("/", 1)[-1]:
        return sequence_frames(checked(not_empty(read_rgb_manifest(spark, f"{path.rstrip('/')}/rgb.txt"), path)))
    if suffix in READERS:
        return READERS[suffix](spark, path)
    raise ValueError(f"no reader for {path}: {'videos are decoded outside' if suffix in VIDEO_SUFFIXES else 'unknown kind'}")


def read_phone_poses(spark: SparkSession, path: str) -> DataFrame:
    """Poses of a phone recording, CSV of t, x, y, z, qw, qx, qy, qz without header, in the order and precision of ground truth."""
    names = ("t", "x", "y", "z", "qw", "qx", "qy", "qz")
    rows = spark.read.schema(", ".join(f"{n} double" for n in names)).csv(path)
    return rows.select(*(F.round(c, 9 if c.startswith("q") else 6).alias(c) for c in ("t", "x", "y", "z", "qx", "qy", "qz", "qw")))


def read_phone_frames(spark: SparkSession, path: str) -> DataFrame:
    """(frame_index, timestamp) of a phone recording's frame list, numbered from 0."""
    return _lines(spark, path).where("line <> ''").select((F.col("line_no") - 1).cast("long").alias("frame_index"), F.split("line", ",")[0].cast("double").alias("timestamp"))


def landscape(fx: float, fy: float, cx: float, cy: float, height: int) -> tuple[float, float, float, float]:
    """Intrinsics of a portrait image turned to landscape, height being the landscape image's: the pixel (u, v) of the portrait is (v, height - u)."""
    return fy, fx, cy, height - cx

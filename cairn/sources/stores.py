"""Sinks and stores: idempotent appends, upserts, published folders and their manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_new(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose key the store doesn't have; returns them. Repeating it adds nothing."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates(keys)
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh


def append_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str, files_at_once: str = "10 seconds"):
    """A streaming query that appends each micro-batch with append_new, so replays add nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, keys) and None).option("checkpointLocation", checkpoint).trigger(processingTime=files_at_once)


def upsert(rows: DataFrame, path: str, keys: list[str], version: str) -> None:
    """Replace a small table by the latest version of every key of it and rows: written aside, then swapped."""
    spark = rows.sparkSession
    every = rows if not exists(spark, path) else spark.read.parquet(path).unionByName(rows)
    rest = [c for c in every.columns if c not in keys]
    latest = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, *[c for c in rest if c != version])).alias("m")).select(*keys, "m.*")
    aside = f"{path}.{uuid.uuid4().hex}"
    latest.write.parquet(aside)
    _swap(spark, aside, path)


def _paths(spark: SparkSession, *names: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = [jvm.org.apache.hadoop.fs.Path(n) for n in names]
    return found[0].getFileSystem(conf), found


def exists(spark: SparkSession, path: str) -> bool:
    files, (at,) = _paths(spark, path)
    return files.exists(at)


def _swap(spark: SparkSession, aside: str, path: str) -> None:
    """Put the folder aside in the place of path; the old one is renamed first and deleted last, so one of them is always whole."""
    old = f"{path}.old-{uuid.uuid4().hex}"
    files, (source, target, kept) = _paths(spark, aside, path, old)
    had = files.exists(target)
    if had:
        files.rename(target, kept)
    files.rename(source, target)
    if had:
        files.delete(kept, True)


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, kind: str, parents: list[str] | None = None, metadata: dict | None = None) -> dict:
    """Write tables and a manifest aside, then rename to path; refuses if path exists. Returns the manifest.

    The manifest lists every file with its size and SHA-256 and the parents' ids; the
    artifact's id is the SHA-256 of that list, so equal content has an equal id.
    """
    if exists(spark, path):
        raise FileExistsError(path)
    aside = f"{path}.{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{aside}/{name}")
    files = payload(spark, aside).drop("path").orderBy("name")
    listed = [r.asDict() for r in files.toLocalIterator()]
    body = {"kind": kind, "parents": sorted(parents or []), "metadata": metadata or {}, "files": [{"sha256": r["sha256"], "bytes": r["bytes"]} for r in sorted(listed, key=lambda r: r["sha256"])]}
    identity = spark.range(1).select(F.sha2(F.lit(json.dumps(body, sort_keys=True)), 256)).first()[0]
    manifest = {"id": identity, **body, "names": [r["name"] for r in listed]}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{aside}/_manifest")
    files_, (source, target) = _paths(spark, aside, path)
    files_.rename(source, target)
    return manifest


def payload(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, bytes, sha256) of the data files below a folder; hashed by the tasks that read them."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return listed.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/_manifest", wholetext=True).first()[0])


def verify(spark: SparkSession, path: str) -> bool:
    """Whether the files are those of the manifest."""
    want = sorted((f["sha256"], f["bytes"]) for f in manifest(spark, path)["files"])
    return sorted((r.sha256, r.bytes) for r in payload(spark, path).select("sha256", "bytes").toLocalIterator()) == want


def pending(planned: DataFrame, done: DataFrame, keys: list[str], identity: str) -> DataFrame:
    """The planned rows that are not done; a done row with another identity fails the job when it is read."""
    both = planned.join(done.select(*keys, F.col(identity).alias("_done")), keys)
    bad = F.raise_error(F.concat(F.lit("done with another identity: "), F.to_json(F.struct(*keys)))).cast("boolean")
    clash = both.where(F.when(F.col(identity).eqNullSafe(F.col("_done")), F.lit(False)).otherwise(bad))  # needs both sides, so it stays above the join
    return planned.join(done.select(*keys), keys, "left_anti").unionByName(clash.drop("_done"))


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One ordered CSV: range-partitioned, sorted files whose names keep the order."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("header", True).csv(path)


def read_frames(spark: SparkSession, path: str, descriptors: bool = True) -> DataFrame:
    """A feature store's rows by frame_index; without descriptors that column is never read."""
    rows = spark.read.parquet(path)
    return (rows if descriptors else rows.drop("descriptors", "descriptor")).orderBy("frame_index")


def has_frame(spark: SparkSession, path: str, frame_index: int) -> bool:
    """Whether the store has the frame; the filter reaches the files' statistics."""
    return not spark.read.parquet(path).where(F.col("frame_index") == frame_index).select("frame_index").limit(1).isEmpty()


def read_pairs(spark: SparkSession, path: str, pair: tuple[int, int] | None = None) -> DataFrame:
    """A store of matches or geometry (first, second, ...) in the order of pairs, or the rows of one."""
    rows = spark.read.parquet(path)
    return rows.orderBy("first", "second") if pair is None else rows.where((F.col("first") == pair[0]) & (F.col("second") == pair[1]))


#: Bytes of a stored position, score and descriptor number.
POSITION_BYTES, SCORE_BYTES, NUMBER_BYTES = 8, 4, {"f16": 2, "f32": 4}


def cached_frames(store: DataFrame, wanted: DataFrame, size: int = 256) -> DataFrame:
    """The frames of a store of packed features that are wanted (timestamp_ns, pts, width, height), by time and pts, with problem.

    A problem is another image size, an unknown encoding, or bytes that don't fit the count
    of features. Wanted frames that the store doesn't have give no row.
    """
    asked = wanted.select("timestamp_ns", "pts", F.col("width").alias("_w"), F.col("height").alias("_h"))
    rows = store.join(asked, ["timestamp_ns", "pts"])
    number = F.create_map(*(F.lit(x) for pair in NUMBER_BYTES.items() for x in pair))[F.col("descriptor_encoding")]
    count = F.col("keypoint_count")
    problem = (
        F.when((F.col("width") != F.col("_w")) | (F.col("height") != F.col("_h")), "another image size")
        .when(number.isNull(), "unknown encoding of descriptors")
        .when((count < 0) | (F.octet_length("keypoints") != count * POSITION_BYTES) | (F.octet_length("scores") != count * SCORE_BYTES) | (F.octet_length("descriptors") != count * size * number), "sizes don't fit the count of features")
    )
    return rows.withColumn("problem", problem).drop("_w", "_h")


def source_state(spark: SparkSession, path: str) -> list[tuple]:
    """(path, length, time) of every file of a source, in order: what changes when the source does."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return sorted((r.path, r.length, r.modificationTime) for r in listed.toLocalIterator())


def publish_unchanged(spark: SparkSession, source: str, build, path: str, kind: str, **options) -> dict:
    """publish what build() makes of a source, unless the source changed meanwhile: then nothing is published and it is an error."""
    before = source_state(spark, source)
    aside = f"{path}.{uuid.uuid4().hex}"
    made = publish(spark, build(), aside, kind, **options)
    files, (draft, target) = _paths(spark, aside, path)
    if source_state(spark, source) != before:
        files.delete(draft, True)
        raise RuntimeError(f"the source changed while it was read: {source}")
    if files.exists(target):
        files.delete(draft, True)
        raise FileExistsError(path)
    files.rename(draft, target)
    return made


def publish_reconstruction(spark: SparkSession, poses: DataFrame, points: DataFrame, observations: DataFrame, path: str, parents: list[str] | None = None, metadata: dict | None = None) -> dict:
    """Publish poses, points (point_id, x, y, z, r, g, b) and observations as one artifact, points as a text point cloud too."""
    cloud = points.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in ("x", "y", "z", "r", "g", "b"))).alias("value"))
    return publish(spark, {"poses": poses, "points": points, "observations": observations, "cloud": cloud}, path, "reconstruction", parents, metadata)


def write_summary(rows: DataFrame, path: str, order: list[str], manifest: dict) -> None:
    """A summary as ordered CSV and its manifest as JSON, both below path; refuses if path exists."""
    spark = rows.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    write_csv(rows, f"{path}/summary", order)
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, status) of the status files of all jobs, the last changed first; files that are no JSON object are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "status.json").load(path)
    rows = files.select("path", F.col("modificationTime").alias("modified"), F.from_json(F.col("content").cast("string"), "map<string,string>").alias("status"))
    return rows.where("status is not null and size(status) > 0").orderBy(F.desc("modified"), "path")

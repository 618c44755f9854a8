"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver did; on a cluster it comes with --py-files or the image."""
    root, known = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known.get("PYTHONPATH")]))


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python in batches of at most so many rows: the default of 10,000 whole texts is tens of MB on either side."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextmanager
def wide_rows(spark: SparkSession, rows: int = 100) -> Iterator[None]:
    """Within it, what runs hands rows to Python in batches of at most so many: for rows of some 100 kB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query has shuffled goes when the query ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark so that any store works."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where it is unset and Spark is local."""
    importable(spark)
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="cairn-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def run_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/cairn-{spark.sparkContext.applicationId}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(conf)
    if files.mkdirs(folder):
        files.deleteOnExit(folder)
    return path


def new_path(spark: SparkSession) -> str:
    """A path in the application's folder that nothing has."""
    return f"{run_dir(spark)}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete what checkpoint() wrote there, once nothing reads it any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def checkpoint(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cut the lineage of df with a table written in the shared folder, at a path of its own where none is given.

    Unlike a checkpointed RDD, a table has its true size: the planner's estimate of a loop's
    rounds, each joined with the one before, would otherwise grow without end.
    """
    spark = df.sparkSession
    path = path or new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""The corpus pipeline: toxicity, SimHash near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of documents. run() writes each stage as Parquet in the shared
folder and reads it again for the next, so a lost executor repeats one stage's tasks only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import mixing, near_copies, packing, pii, toxicity
from cairn.session import remove, run_dir, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are predicted to be toxic.

    Null and empty texts are scored like any other; repeated rows go or stay together; an empty table stays empty. All columns stay.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group with a similarity of 0.8 on five-word shingles, found by their SimHash fingerprints."""
    return near_copies.keep_first(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and terms that disclose it; n_chars follows the text."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chooses documents so that domains, languages and sources meet their weights; a row per epoch."""
    return mixing.mix(docs, added=())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the chosen documents into token sequences; holds few words, as the executors still hold what earlier stages needed."""
    return packing.pack_documents(docs, kept=100_000)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trees, fingerprints and tokenizers have no SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents; a stage's files go once the next one has read them."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{run_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs

"""Exact duplicates by an extendible-hash index on shared files, with DataFrame functions only.

Directory. A text's key is its 64-bit hash. A bucket is a prefix of the key's bits and holds
at most ``CAPACITY`` different keys; copies share a key, so no group of copies fills one. The
directory starts with as many bits as the keys need on average; as long as a bucket is
overfull, the directory doubles by one bit and the overfull buckets split in two. A bucket
that the whole key can't split keeps its overflow. The directory has a row for each slot
(each value of its bits) with the slot's bucket; it is a table in the shared folder.

Owners. Slots are dealt to owner tasks in ranges of keys. An owner gets the whole texts of
its ranges and compares their bytes: the different texts of a key become its chain. A key
with more rows than ``SHARE`` of the table is dealt to several owners by a salt and its chains
are put together after each owner has made one entry of its copies. The chains, with the row
that stays, the number of rows and the digest of each, are the index, written in the shared
folder by bucket.

Lookup. A document finds its slot, bucket and key. Where a key's chain has one text, that is
the document's; where texts collide, the document's bytes are compared with those of the
chain's heads.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import checkpoint

CAPACITY = 1024
#: A key with more than so large a share of all rows is dealt to several owners; at most 1 / SHARE keys are.
SHARE = 1 / 2048
#: Fewer rows than this are never dealt to several owners.
LEAST_SHARED = 256
#: Bytes of text that an owner task gets, about.
OWNER_BYTES = 64 << 20


def hashed(docs: DataFrame, id_col: str, text_col: str, key_bits: int) -> DataFrame:
    """(id, text, key): the whole text, null as empty, and the first bits of its hash as a number that is not negative."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    return rows.withColumn("key", F.shiftrightunsigned(F.xxhash64("text"), 64 - key_bits))


def directory(keys: DataFrame, key_bits: int, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, bucket, depth) of every slot that holds a key, and the directory's bits. keys: a row for each different key."""
    n = keys.count()
    bits = min(key_bits, max(0, math.floor(math.log2(max(1, n) / capacity))))
    closed, rest = [], keys.select("key")
    while True:
        bucket = F.shiftright("key", key_bits - bits)
        held = checkpoint(rest.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("load")))
        full = held.where(F.col("load") > capacity) if bits < key_bits else held.limit(0)
        closed.append((bits, held.where(F.col("load") <= capacity) if bits < key_bits else held))
        if full.isEmpty():
            break
        # the directory doubles: a bit more, and the overfull buckets alone are split by it
        rest = rest.join(full.select("bucket"), bucket == F.col("bucket"), "left_semi")
        bits += 1
    slots = None
    for depth, held in closed:
        width = bits - depth
        own = held.select(
            F.explode(F.sequence(F.shiftleft("bucket", width), F.shiftleft("bucket", width) + F.lit((1 << width) - 1))).alias("slot"),
            F.shiftleft("bucket", key_bits - depth).alias("bucket"),
            F.lit(depth).alias("depth"),
        )
        slots = own if slots is None else slots.unionByName(own)
    return checkpoint(slots), bits


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 63, capacity: int = CAPACITY, share: float = SHARE, least_shared: int = LEAST_SHARED) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, bucket, chain) for each row: of the rows with one text the largest id stays.

    Texts are equal if their bytes are; null counts as the empty text, which is a text like any
    other. bucket is the first key of the row's bucket; chain numbers the different texts of a
    key from 1. Null ids are below all others and stay only where no row of the group has an
    id. Rows that repeat an id and its text count each and stay or go together. Ids can be of
    any ordered type. Other columns are ignored, whatever their names; an empty table gives no
    rows. Texts can be of any length: an owner's share is sized by bytes, a single text is a row.
    """
    if not 1 <= key_bits <= 63:
        raise ValueError("key_bits must be from 1 to 63")
    spark = docs.sparkSession
    rows = hashed(docs, id_col, text_col, key_bits)
    keys = checkpoint(rows.select("id", "key", F.octet_length("text").cast("long").alias("size")))
    by_key = checkpoint(keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size")))
    slots, bits = directory(by_key, key_bits, capacity)
    total, size = by_key.agg(F.sum("rows"), F.sum("size")).first()
    shared = max(least_shared, math.ceil((total or 0) * share))

    # Owner tasks: ranges of keys, whole texts, bytes compared. At most 1 / share keys are shared, so they can be sent to all.
    owners = max(2 * spark.sparkContext.defaultParallelism, -(-(size or 0) // OWNER_BYTES))
    fine = 16 * owners  # ranges are finer than tasks, so that tasks get about the same
    many = by_key.where(F.col("rows") > shared).select("key", F.ceil(F.col("rows") / shared).cast("long").alias("salts"))
    dealt = rows.join(F.broadcast(many), "key", "left").select(
        "id",
        "text",
        "key",
        F.floor(F.col("key") / F.lit(2.0**key_bits) * fine).alias("range"),
        F.col("salts").isNotNull().alias("split"),
        F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("salts"))).otherwise(F.lit(0)).alias("salt"),
    )
    owned = dealt.repartition(owners, "range", "salt").groupBy("range", "salt", "split", "key", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # An unshared text is whole where its owner has seen it; only shared keys' texts go on to be put together.
    alone = F.when(~F.col("split"), F.col("keep_id"))
    told = owned.select("key", F.sha2("text", 256).alias("text_sha256"), F.when(F.col("split"), F.col("text")).alias("whole"), alone.alias("alone"), "keep_id", "group_size")
    chains = told.groupBy("key", "text_sha256", "whole", "alone").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    place = Window.partitionBy("key").orderBy("text_sha256", "keep_id")
    slot = F.shiftright("key", key_bits - bits).alias("slot")
    index = chains.drop("whole", "alone").withColumn("chain", F.row_number().over(place)).withColumn("links", F.count(F.lit(1)).over(Window.partitionBy("key")))
    index = index.select(slot, "*").join(slots, "slot").drop("slot")
    index = checkpoint(index.repartitionByRange("bucket").sortWithinPartitions("bucket", "key", "chain"))

    # Lookup
    asked = keys.select("id", "key", slot).join(slots, "slot").select("id", "key", "bucket")
    entry = ["key", "bucket", "keep_id", "group_size", "text_sha256", "chain"]
    found = asked.join(index.where(F.col("links") == 1).select(*entry), ["key", "bucket"])
    if not (colliding := index.where(F.col("links") > 1).select(*entry)).isEmpty():
        several = rows.join(colliding.select("key").distinct(), "key", "left_semi")
        heads = several.where(F.col("id").isNotNull()).select("key", F.col("id").alias("keep_id"), "text").distinct()
        heads = colliding.join(heads, ["key", "keep_id"], "left").where(F.sha2(F.col("text"), 256) == F.col("text_sha256"))
        nameless = colliding.where(F.col("keep_id").isNull()).join(several.where(F.col("id").isNull()).select("key", "text").distinct(), "key").where(F.sha2(F.col("text"), 256) == F.col("text_sha256"))
        heads = heads.unionByName(nameless.select(heads.columns))
        found = found.unionByName(several.join(heads, ["key", "text"]).select(found.columns))
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        "bucket",
        "chain",
    )

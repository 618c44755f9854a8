"""SimHash near-duplicates by covering-code anchors.

Fingerprint. 64-bit SimHash over the three-word shingles of the text, each weighted by how
often it occurs; a shingle's hash is XXH64 with seed 42.

Linking. The anchors are the words of a product of four perfect codes that fills the 64
bits exactly: two Golay (23, 12) codes of covering radius 3, a Hamming (15, 11) code of
radius 1 and a repetition code of length 3 and radius 1. So there are 2^36 anchors, every
fingerprint lies within the covering radius 8 of one, block by block. Two fingerprints at
most t bits apart have a midpoint within ceil(t/2) bits of both; the midpoint lies within
the covering radius of its anchor, so both lie within covering radius plus ceil(t/2) of
that anchor. Each fingerprint is therefore replicated to every anchor within that reach
(the threshold's share of the reach, t, is halved because both ends of a pair are
replicated) and compared with the others per anchor: about 17 rows for t = 2, no pair lost.

Crowded anchors. A cluster of near copies can put any number of fingerprints under one
anchor. Fingerprints of anchors with more than ``crowded`` members are dealt out again
with the finest code, that of all 64-bit words (covering radius 0): each goes to the 65
words within one bit, and those sharing a word are within two bits of each other, so a
star to the smallest is exact and no group has more than 65 members.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import workers
from cairn.operators.components import connected_components
from cairn.session import checkpoint, text_batches

SHINGLE = 3
THRESHOLD = 2
CROWDED = 256
SEED = 42

#: Fixed values: (first bit, length, check bits, covering radius) of each block; the Golay and Hamming codes are cyclic with these generator polynomials.
BLOCKS = ((0, 23, 11, 3), (23, 23, 11, 3), (46, 15, 4, 1), (61, 3, 2, 1))
GENERATORS = {23: 0b110001110101, 15: 0b10011, 3: 0b111}


def fingerprint(text: str | None) -> int:
    """The text's SimHash, unsigned; null and texts without words give 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, carried: list[str], text_col: str = "text") -> DataFrame:
    """The carried columns of docs, and fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("simhash")
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(0).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps, pa.int64())], names=[*carried, "fp"])

    text_batches(docs.sparkSession)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return docs.select(F.col(text_col).alias("_shingled"), *(F.col(c) for c in carried)).mapInArrow(run, f"{kinds}, fp long")


@lru_cache
def _code(length: int, checks: int, reach: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Syndromes of the unit words, and for each syndrome the error patterns of weight <= reach, by weight."""
    units = np.zeros(length, dtype=np.int64)
    for i in range(length):
        word = 1 << i
        for bit in range(i, checks - 1, -1):
            if word >> bit & 1:
                word ^= GENERATORS[length] << (bit - checks)
        units[i] = word
    found: list[list[int]] = [[] for _ in range(1 << checks)]
    for weight in range(reach + 1):
        for ones in itertools.combinations(range(length), weight):
            syndrome = 0
            for i in ones:
                syndrome ^= int(units[i])
            found[syndrome].append(sum(1 << i for i in ones))
    return units, [np.array(x, dtype=np.uint64) for x in found]


def anchors(fps: np.ndarray, threshold: int = THRESHOLD, blocks: tuple = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): every anchor of the blocks' codes within the covering radius plus half the threshold of each fingerprint."""
    fps = fps.astype(np.uint64)
    slack = -(-threshold // 2)
    nearest, wider = [], []
    for first, length, checks, radius in blocks:
        words = fps >> np.uint64(first) & np.uint64((1 << length) - 1)
        units, _ = _code(length, checks, radius)
        syndromes = np.zeros(len(fps), dtype=np.int64)
        for i in range(length):
            syndromes ^= np.where(words >> np.uint64(i) & np.uint64(1), units[i], 0)
        lists = [_code(length, checks, min(length, radius + extra))[1] for extra in range(slack + 1)]
        nearest.append(words ^ np.array([x[0] for x in lists[0]])[syndromes])
        # the patterns that only a further bit of reach adds, laid out flat
        per = []
        for extra in range(slack + 1):
            old = lists[extra - 1] if extra else [np.zeros(0, np.uint64)] * len(lists[0])
            new = [x[len(y) :] for x, y in zip(lists[extra], old, strict=True)]
            sizes = np.array([len(x) for x in new])
            flat, starts = np.concatenate([*new, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            count = sizes[syndromes]
            rows = np.repeat(np.arange(len(fps)), count)
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[syndromes], count)
            per.append((rows, words[rows] ^ flat[at]))
        wider.append(per)
    rows_out, anchors_out = [], []
    for extras in itertools.product(range(slack + 1), repeat=len(blocks)):
        if sum(extras) > slack:
            continue
        rows, anchor = np.arange(len(fps)), np.zeros(len(fps), np.uint64)
        for (first, *_), extra, per, near in zip(blocks, extras, wider, nearest, strict=True):
            if extra == 0:
                anchor |= near[rows] << np.uint64(first)
                continue
            own, words = per[extra]
            size = np.bincount(own, minlength=len(fps))
            begin = np.cumsum(size) - size
            count = size[rows]
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[rows], count)
            rows, anchor = np.repeat(rows, count), np.repeat(anchor, count) | words[at] << np.uint64(first)
        rows_out.append(rows)
        anchors_out.append(anchor)
    return np.concatenate(rows_out), np.concatenate(anchors_out)


def near_pairs(distinct: DataFrame, threshold: int = THRESHOLD, crowded: int = CROWDED) -> DataFrame:
    """(src, dst): links between distinct fingerprints (column fp) at most threshold bits apart.

    Of the members of an anchor with more than ``crowded`` fingerprints, only a spanning set
    of the links is given: enough for their components, and each one within the threshold.
    """
    if threshold > 2:
        raise ValueError("crowded anchors are resolved exactly for thresholds up to 2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("simhash")
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            rows, anchor = anchors(fps.view(np.uint64), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fps[rows])], names=["anchor", "fp"])

    replicas = distinct.select("fp").mapInArrow(run, "anchor long, fp long")
    hot = checkpoint(replicas.groupBy("anchor").count().where(F.col("count") > crowded).select("anchor"))
    if hot.isEmpty():
        calm, star = replicas, None
    else:
        calm = replicas.join(hot, "anchor", "left_anti")
        words = (
            replicas.join(hot, "anchor", "left_semi")
            .select("fp")
            .distinct()
            .select(
                "fp",
                F.explode(
                    F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))) if threshold > 0 else F.array("fp")
                ).alias("word"),
            )
        )
        first = words.groupBy("word").agg(F.min("fp").alias("dst"))
        star = words.join(first, "word").where("fp <> dst").select(F.col("fp").alias("src"), "dst").where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= threshold)
    a = calm.select("anchor", F.col("fp").alias("src"))
    b = calm.select("anchor", F.col("fp").alias("dst"))
    pairs = a.join(b, "anchor").where((F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= threshold)).select("src", "dst")
    return (pairs if star is None else pairs.union(star)).distinct()


def simhash_groups(docs: DataFrame, threshold: int = THRESHOLD, crowded: int = CROWDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id), one row per row of docs; other columns are ignored.

    Exact copies share a fingerprint and are compared once. component_id is the smallest id
    that links of at most ``threshold`` bits reach, itself included. Null text counts as
    empty; texts without words have fingerprint zero and link like any others. Rows with a
    null id take part: their component is the smallest known id, or null if there is none.
    An empty table gives no rows.
    """
    marked = checkpoint(fingerprints(docs, [id_col], text_col))
    classes = checkpoint(marked.groupBy("fp").agg(F.min(id_col).alias("first_id")))
    linked = connected_components(near_pairs(classes, threshold, crowded))
    labelled = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    members = checkpoint(labelled.join(smallest, "label").select("fp", "component_id"))
    return marked.join(members, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

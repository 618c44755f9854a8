"""Packing token sequences by first-fit decreasing in randomised groups of documents.

A document's ids are cut into pieces of at most ``capacity`` ids. Documents are dealt into
groups by a seeded hash of their id; each group packs its pieces, longest first, into the
first sequence that has room. A tournament tree over the sequences' free room finds that
one in logarithmic time. Only (id, start, length) rows are shuffled, never texts or ids,
and a group has ``group_docs`` documents on average. The hash is of the id and the ids'
checksum, so null and repeated ids are spread; what repeats in both, more than ``REPEATS``
times in a task, gets a hash of the task's own for every REPEATS of it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.tokens import KEPT, encoder
from cairn.session import text_batches

CAPACITY = 1024
GROUP_DOCS = 8192
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"

#: Documents of one hash that go to one group, counted by a task in a table of fixed size.
REPEATS, COUNTED = 16, 1 << 18

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID, kept: int = KEPT) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, _deal): the pieces of every document, end id included; _deal is the document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer, keeps_space=True, kept=kept)
        end = int(end_id).to_bytes(4, "little")
        met, task = np.zeros(COUNTED, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            rows, starts, lengths, sums, totals, deals = [], [], [], [], [], []
            keys = batch.column(0).to_pylist()
            for row, own in enumerate(ids.ids(batch.column(1).to_pylist())):
                own += end
                n = len(own) // 4
                deal = zlib.crc32(own, zlib.crc32(repr(keys[row]).encode()))
                slot = deal % COUNTED
                if met[slot] >= REPEATS:
                    deal |= zlib.crc32(b"%d %d" % (task, met[slot] // REPEATS)) << 32
                met[slot] += 1
                for start in range(0, n, capacity):
                    piece = own[4 * start : 4 * (start + capacity)]
                    rows.append(row)
                    starts.append(start)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    totals.append(n)
                    deals.append(deal)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (starts, lengths, sums, totals, deals))], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "_deal"])

    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, {PIECES}, _deal long")


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, in the order given; lengths are sorted, longest first.

    ``tree`` is a tournament: a node holds the most room of any bin below it, so the first
    bin with enough room is found by walking down and keeping left where the left side has it.
    """
    n = len(lengths)
    size = 1 << max(0, int(n - 1).bit_length())
    tree = [capacity] * (2 * size)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, length in enumerate(lengths.tolist()):
        node = 1
        while node < size:
            node *= 2
            if tree[node] < length:
                node += 1
        bins[i], offsets[i] = node - size, capacity - tree[node]
        tree[node] -= length
        while node > 1:
            node //= 2
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
    return bins, offsets


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, seed: int = 0, tokenizer: str = TOKENIZER, end_id: int = END_ID, kept: int = KEPT) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length), one row per piece.

    Pieces cover each document without gap or overlap and fill each sequence from offset 0
    without gaps. padded_length is ``capacity``, or the filled length where that is a power
    of two. Null text counts as empty and leaves the end id; null and repeated ids are
    documents of their own, spread over the groups; other columns are ignored; an empty
    table gives no rows. A group is held whole in a task: a row for each piece of its
    documents.
    """
    pieces = token_pieces(docs, id_col, text_col, capacity, tokenizer, end_id, kept)
    groups = max(1, -(-docs.count() // group_docs))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), F.col("_deal")), F.lit(groups))).drop("_deal")
    dealt = dealt.repartition(F.col("group")).sortWithinPartitions("group", F.desc("length"), id_col, "start", "ids_crc32", "doc_tokens")

    def pack(group: int, rows: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        filled = np.bincount(bins, weights=rows["length"].to_numpy()).astype(np.int64)
        padded = np.where(filled & (filled - 1) == 0, filled, capacity)
        return rows.drop(columns="group").assign(sequence_id=(np.int64(group) << 32) + bins, offset=offsets, padded_length=padded[bins])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        group = -1
        for frame in frames:
            for own, rows in frame.groupby("group", sort=False):
                if own != group:
                    if waiting:
                        yield pack(group, pd.concat(waiting))
                    waiting, group = [], own
                waiting.append(rows)
        if waiting:
            yield pack(group, pd.concat(waiting))

    kind = docs.schema[id_col].dataType.simpleString()
    return dealt.mapInPandas(run, f"`{id_col}` {kind}, {PIECES}, sequence_id long, offset long, padded_length long")

"""Ranked lexical search by dense blocks: integer impacts of documents times term weights of items.

Statistics. One pass over the texts leaves, for each document, its number of terms and how
often it holds each term of the items; a table of that, in the shared folder, is all that
the rest reads. Document frequencies, the number of documents and their terms are sums over it.

Tiles. Items are cut into tiles of at most ``TILE_ITEMS``. A tile has a compact vocabulary of
its own terms, cut into tiles of at most ``TILE_TERMS`` terms whose weights, summed for any item,
stay below 2^53 divided by the largest impact. So the product of a tile of document impacts and
a tile of weights is exact in float64, whatever the order in which BLAS adds; the products
of the vocabulary tiles are added as integers.

Top k. A task keeps the k best documents of each item; a document that equals the k-th so far is
kept until ids decide, so ties are safe. The tasks' bests, k rows each, are ranked by item.

Items are searched in rounds of at most ``ROUND_BYTES`` of item text, so that what is sent to all
executors has a bound; each round reads the documents again.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import checkpoint, new_path, remove, text_batches

#: Fixed values of the scores: impacts, length normalisation, weights.
IMPACT, STEP, FLAT, SHARE, WEIGHT = 1_000_000_000, 1000, 12, 25, 1000
#: An impact is below this: IMPACT * tf / (STEP * tf + something positive).
MOST_IMPACT = IMPACT // STEP
EXACT = 1 << 53
TILE_ITEMS = 256
TILE_TERMS = 2048
TILE_DOCS = 512
#: Bytes of item text whose vocabulary and weights go to all executors at once.
ROUND_BYTES = 4 << 20

_SEPARATORS = [b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]
_PLAIN = bytes(32 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text: letters and digits of ASCII and everything beyond it; A-Z are lower-cased. A null text has none."""
    return text.translate(_PLAIN).split() if text else []


def weight_tiles(weights: np.ndarray, most_terms: int = TILE_TERMS, bound: int = (EXACT - 1) // MOST_IMPACT) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cut a matrix of integer weights (terms, items) into (terms, weights) with at most so many terms and no item's sum above the bound.

    A weight above the bound is itself cut; its term is then in several tiles.
    """
    out, rest, at = [], weights.astype(np.int64), 0
    while at < len(rest):
        stop, total = at, np.zeros(rest.shape[1], np.int64)
        while stop < len(rest) and stop - at < most_terms and (total + rest[stop]).max(initial=0) <= bound:
            total += rest[stop]
            stop += 1
        if stop == at:  # one weight alone is too much
            part = np.minimum(rest[at], bound)
            out.append((np.array([at]), part[None].astype(np.float64)))
            rest[at] -= part
            continue
        out.append((np.arange(at, stop), rest[at:stop].astype(np.float64)))
        at = stop
    return out


class Best:
    """The k best documents of each item of a tile; equal scores go to the smaller id, null ids last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.least = k, np.zeros(items, np.int64)
        self.held: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]

    def add(self, ids: np.ndarray, absent: np.ndarray, scores: np.ndarray) -> None:
        """scores: (documents, items). Only what is above zero and not below the k-th so far is looked at."""
        for item in np.flatnonzero(((scores >= self.least) & (scores > 0)).any(0)):
            own = scores[:, item]
            rows = np.flatnonzero((own >= self.least[item]) & (own > 0))
            held = self.held[item] + list(zip((-own[rows]).tolist(), absent[rows].tolist(), ids[rows].tolist(), strict=True))
            held.sort()
            self.held[item] = held[: self.k]
            if len(held) >= self.k:
                self.least[item] = -self.held[item][-1][0]


def ranked(documents: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", round_bytes: int = ROUND_BYTES, tile: tuple[int, int, int] = (TILE_ITEMS, TILE_TERMS, TILE_DOCS)) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 for each row of items.

    A document without a term (null and empty ones too) counts nowhere and scores 0; an item without a term gets no row.
    Each row of documents is a document: rows that repeat an id or text each count and can each be ranked; equal
    scores go to the smaller id, null ids come last. Items that share an id are searched as one item with the terms of all
    of them. Texts are taken whole, of any length. Other columns are ignored; where one of the tables is empty, so is the
    result. Ids are longs.
    """
    spark = documents.sparkSession
    text_batches(spark)
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds, out = max(1, -(-size // round_bytes)), None
    for number in range(rounds):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == number)
        found = _round(documents, own, k, id_col, text_col, tile)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    best = out if out is not None else spark.createDataFrame([], "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _round(documents: DataFrame, items: DataFrame, k: int, id_col: str, text_col: str, tile: tuple[int, int, int]) -> DataFrame | None:
    """The tasks' best rows for items whose text has a bound, so that they can come to the driver and go to all executors."""
    spark = documents.sparkSession
    wanted: dict[int | None, Counter] = {}
    for row in items.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        wanted.setdefault(row.item_id, Counter()).update(terms(bytes(row.text) if row.text is not None else None))
    wanted = {i: c for i, c in sorted(wanted.items(), key=lambda x: (x[0] is None, x[0] or 0)) if c}
    if not wanted:
        return None
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*wanted.values())))}
    sent = spark.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            sizes, held, times = [], [], []
            for text in batch.column(1).to_pylist():
                found = terms(text)
                sizes.append(len(found))
                own = sorted((known[t], n) for t, n in Counter(found).items() if t in known)
                held.append([t for t, _ in own])
                times.append([n for _, n in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "times"])

    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    path = new_path(spark)
    counted = checkpoint(texts.mapInArrow(count, "doc_id long, n long, terms array<int>, times array<long>").where(F.col("n") > 0), path)
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    frequency = np.zeros(len(vocabulary), np.int64)
    for row in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the round's items
        frequency[row.term] = row["count"]
    weight = np.array([math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in frequency.tolist()], np.int64)

    tile_items, tile_terms, tile_docs = tile
    names, tiles = list(wanted), []
    for at in range(0, len(names), tile_items):
        own = names[at : at + tile_items]
        local = sorted({vocabulary[t] for i in own for t in wanted[i]})
        place = {t: i for i, t in enumerate(local)}
        matrix = np.zeros((len(local), len(own)), np.int64)
        for column, i in enumerate(own):
            for t, times in wanted[i].items():
                matrix[place[vocabulary[t]], column] = times * weight[vocabulary[t]]
        useful = matrix.any(1)  # terms that nearly all documents hold weigh nothing
        tiles.append((own, np.array(local, np.int64)[useful], weight_tiles(matrix[useful], tile_terms)))
    plan = spark.sparkContext.broadcast(tiles)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(own), k) for own, _, _ in plan.value]
        for batch in batches:
            for at in range(0, len(batch), tile_docs):
                part = batch.slice(at, tile_docs)
                column = part.column(0)
                absent = np.array(column.is_null(), bool)
                ids = np.array(column.fill_null(0), np.int64)
                lengths = np.diff(np.array(part.column(2).offsets, np.int64))
                held, times = np.array(part.column(2).flatten(), np.int64), np.array(part.column(3).flatten(), np.int64)
                doc = np.repeat(np.arange(len(part)), lengths)
                m = np.array([100 - SHARE + SHARE * n * n_docs // n_terms for n in part.column(1).to_pylist()], np.int64)
                impact = IMPACT * times // (STEP * times + FLAT * m[doc])
                for (own, local, parts), kept in zip(plan.value, best, strict=True):
                    spot = np.searchsorted(local, held)
                    here = np.flatnonzero((spot < len(local)) & (local[np.minimum(spot, max(len(local) - 1, 0))] == held)) if len(local) else np.zeros(0, np.int64)
                    scores = np.zeros((len(part), len(own)), np.int64)
                    for rows, weights in parts:
                        inside = here[(spot[here] >= rows[0]) & (spot[here] <= rows[-1])]
                        if len(inside):
                            dense = np.zeros((len(part), len(rows)))
                            dense[doc[inside], spot[inside] - rows[0]] = impact[inside]
                            scores += (dense @ weights).astype(np.int64)
                    kept.add(ids, absent, scores)
        rows = [(name, None if absent else i, -score) for (own, _, _), kept in zip(plan.value, best, strict=True) for name, held in zip(own, kept.held, strict=True) for score, absent, i in held]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["item_id", "doc_id", "score"])

    found = checkpoint(counted.mapInArrow(search, "item_id long, doc_id long, score long"))
    remove(spark, path)
    return found

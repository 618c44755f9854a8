"""Exact top-k inner products over a bit-sliced index.

Index. Rows are cut into blocks of at most ``BLOCK_ROWS``. A block keeps, for each
attribute, its least value and one bitmap per bit of what exceeds it: bit r of the bitmap
is that bit in row r.

Dealing. Blocks stay where they are dealt and are met by the queries, which are few and
small: a batch of queries is a row, sent once to every block. A task reads its block first
and then one batch after the other, so it holds one block and one batch, and what is
shuffled is the index once and the queries once for each block.

Search. A query's scores over a block are one bit-sliced number: for every set bit of a
weight the attribute's slices, shifted, are added by bitmap arithmetic (for negative
weights the complemented slices). The best k rows are then found from the most significant
slice downward, keeping the rows that are certainly in and those still level; the rows
level to the end are the boundary and are resolved by id. Chosen rows get their exact
integer score. Only k rows per query and block leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import checkpoint, text_batches

SCALE = 256
BLOCK_ROWS = 131_072
#: Smaller blocks are made, down to so many rows, to have one for every core.
LEAST_ROWS = 1024
QUERY_BATCH = 128
LONG = (-(1 << 63), (1 << 63) - 1)

_BLOCK = "dims int, block long, ids array<long>, base array<long>, widths array<int>, slices binary"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, vec) of the rows whose vector is whole and finite: floor(scale * x) of each component."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.expr("vec is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return rows.where(finite).select("id", F.transform("vec", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("vec"))


def build_block(ids: np.ndarray, values: np.ndarray) -> dict:
    """Slices of rows that are sorted by id; values is (rows, attributes)."""
    base = values.min(0) if len(values) else np.zeros(values.shape[1], np.int64)
    words = -(-len(ids) // 64)
    widths, out = [], []
    for d in range(values.shape[1]):
        over = (values[:, d] - base[d]).view(np.uint64)  # modulo 2^64, so any range is exact
        width = int(over.max(initial=0)).bit_length()
        widths.append(width)
        for b in range(width):
            bits = np.zeros(words * 64, np.uint8)
            bits[: len(ids)] = over >> np.uint64(b) & np.uint64(1)
            out.append(np.packbits(bits, bitorder="little"))
    return {"base": base.tolist(), "widths": widths, "slices": np.concatenate(out).tobytes() if out else b""}


class Block:
    """A block's slices, ready for queries."""

    def __init__(self, ids: list, base: list[int], widths: list[int], slices: bytes) -> None:
        self.ids, self.base = [None if pd.isna(i) else int(i) for i in ids], [int(x) for x in base]
        words = -(-len(ids) // 64)
        flat = np.frombuffer(slices, np.uint64).reshape(-1, words) if words else np.zeros((0, 0), np.uint64)
        at = np.cumsum([0, *widths])
        self.slices = [[flat[i] for i in range(a, b)] for a, b in zip(at, at[1:], strict=False)]
        self.complements = [[~s for s in own] for own in self.slices]
        self.valid = np.zeros(words * 64, np.uint8)
        self.valid[: len(ids)] = 1
        self.valid = np.packbits(self.valid, bitorder="little").view(np.uint64)
        self.rows = {}
        for row, i in enumerate(self.ids):
            self.rows.setdefault(i, []).append(row)

    def scores(self, query: list[int]) -> list[np.ndarray]:
        """Slices, least significant first, of a number that orders the rows as the inner product does."""
        total: list[np.ndarray] = []
        bound = 0
        for d, weight in enumerate(query):
            own = self.slices[d] if weight > 0 else self.complements[d]
            if not own or not weight:
                continue
            size = abs(weight)
            for shift in range(size.bit_length()):
                if not size >> shift & 1:
                    continue
                bound += (1 << len(own)) - 1 << shift
                while len(total) < bound.bit_length():
                    total.append(np.zeros_like(self.valid))
                carry = None
                for at, w in enumerate(own, shift):
                    a = total[at]
                    x = a ^ w
                    if carry is None:
                        carry = a & w
                        total[at] = x
                    else:
                        total[at] = x ^ carry
                        x &= carry
                        carry = a & w
                        carry |= x
                for at in range(shift + len(own), bound.bit_length()):
                    a = total[at]
                    total[at] = a ^ carry
                    carry = a & carry
        return total

    def best(self, query_id: int, query: list[int], k: int) -> list[int]:
        """The rows of the k best, those of the query's id left out; ties go to the earlier row."""
        level = self.valid.copy()
        for row in self.rows.get(query_id, ()):
            level[row // 64] &= ~np.uint64(1 << row % 64)
        sure = np.zeros_like(level)
        n_sure = 0
        for part in reversed(self.scores(query)):
            ahead = level & part
            n = n_sure + int(np.bitwise_count(ahead).sum())
            if n > k:
                level = ahead
            else:
                sure |= ahead
                n_sure = n
                level &= ~part
                if n == k:
                    level[:] = 0
                    break
        rows = lambda bits: np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))
        return [*rows(sure).tolist(), *rows(level)[: k - n_sure].tolist()]

    def values(self, row: int) -> list[int]:
        """The row's attributes, put together from the slices."""
        word, bit = row // 64, row % 64
        return [b + sum((int(s[word]) >> bit & 1) << i for i, s in enumerate(own)) for b, own in zip(self.base, self.slices, strict=True)]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_batch: int = QUERY_BATCH) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its k best other rows.

    Scores are inner products of floor(scale * x); ties go to the smaller id, null ids come
    last. Fewer than k rows give all. Vectors that are null or hold null or non-finite
    components take no part; vectors meet those of their own length only. Rows that share
    the query's id are left out; repeated query rows are searched once, and a repeated
    candidate counts as often as it occurs. A floor or a score beyond a long is the nearest
    long. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    text_batches(spark)  # a row is a block or a batch of queries
    rows = quantised(vectors, id_col, vec_col, scale)
    n = rows.count()
    block_rows = min(block_rows, max(LEAST_ROWS, -(-n // spark.sparkContext.defaultParallelism)))

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}
        made = 0

        def block(dims: int) -> pd.DataFrame:
            own = pd.concat(held.pop(dims)).sort_values("id", na_position="last", kind="stable")
            ids = [None if pd.isna(i) else int(i) for i in own["id"]]
            found = build_block(np.array(ids, dtype=object), np.array(own["vec"].tolist(), np.int64).reshape(len(own), dims))
            return pd.DataFrame([{"dims": dims, "block": (TaskContext.get().partitionId() << 32) + made, "ids": ids, **found}])

        for frame in frames:
            sizes = frame["vec"].map(len).to_numpy()
            for dims in np.unique(sizes).tolist():
                part = frame[sizes == dims]
                while len(part):
                    room = block_rows - sum(map(len, held.get(dims, ())))
                    held.setdefault(dims, []).append(part.iloc[:room])
                    part = part.iloc[room:]
                    if sum(map(len, held[dims])) == block_rows:
                        yield block(dims)
                        made += 1
        for dims in list(held):
            yield block(dims)
            made += 1

    blocks = checkpoint(rows.repartition(max(1, -(-n // block_rows))).mapInPandas(index, _BLOCK))
    queries = rows.where(F.pmod(F.col("id"), F.lit(every)) == 0).distinct().withColumn("dims", F.size("vec"))
    batches = max(1, -(-queries.count() // query_batch))
    asked = queries.groupBy("dims", F.pmod(F.xxhash64("id", "vec"), F.lit(batches)).alias("batch")).agg(F.collect_list("id").alias("query_ids"), F.flatten(F.collect_list("vec")).alias("weights"))
    # a row for each block: a 131,072nd of the vectors
    sent = asked.join(F.broadcast(blocks.select("dims", "block")), "dims").select("block", F.lit(1).alias("turn"), "query_ids", "weights")
    stream = blocks.withColumn("turn", F.lit(0)).unionByName(sent, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "turn")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = None
        for frame in frames:
            for row in frame.itertuples():
                if row.turn == 0:
                    block = Block(row.ids, row.base, row.widths, row.slices)
                    continue
                out = []
                for query_id, vec in zip(row.query_ids, np.reshape(row.weights, (len(row.query_ids), -1)), strict=True):
                    weights = [int(x) for x in vec]
                    for at in block.best(query_id, weights, k):
                        score = sum(x * y for x, y in zip(weights, block.values(at), strict=True))
                        out.append((query_id, hash(tuple(weights)), block.ids[at], min(max(score, LONG[0]), LONG[1])))
                yield pd.DataFrame(out, columns=["query_id", "version", "vec_id", "score"]).astype({"vec_id": "Int64"})

    found = stream.mapInPandas(search, "query_id long, version long, vec_id long, score long")
    order = Window.partitionBy("query_id", "version").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

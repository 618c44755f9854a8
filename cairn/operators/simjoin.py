"""Similarity joins between the features of two frames.

All pairs of frames are planned as pairs of blocks of frames: a frame is copied once per
block, groups hold two blocks, and a group's pairs are matrix products, a frame against a
stack of frames at once. No pair of features is ever a row unless it matches, and what
matches leaves a task in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (indices of matched left and right rows, score, distance) of two descriptor matrices
Matches = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
Matcher = Callable[[np.ndarray, np.ndarray], Matches]
NONE: Matches = (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0))

EDGES = "first long, second long, left_id long, right_id long, score double, distance double"
TOTALS = "first long, second long, matches long, score double"

#: Scores of a frame against a stack of frames that are computed at once, and rows of a batch that leaves a task, at most about.
STACK_SCORES, BATCH_ROWS = 1 << 18, 1 << 16
#: Scores that differ less may be the same number.
CLOSE = 1e-12


class Stacked(NamedTuple):
    """What a matcher does for a frame and a stack of frames at once, in attribute ``stacked`` of those that can.

    prepare(rows) gives arrays that are lined up with the rows of a block; match(own, others, missing) takes those of
    one frame, (n, ...), and of the stack, (k, m, ...), of which the rows in missing (k, m), if it is given, are padding,
    and gives (frame, left, right, score, distance or None, where it is that of the rows, and the frames that are too close to call).
    A product's last digits depend on the shape of the stack, so what lies within CLOSE is left to the matcher itself, pair by pair,
    and scores are computed from their two rows.
    """

    prepare: Callable[[np.ndarray], tuple[np.ndarray, ...]]
    match: Callable[[tuple[np.ndarray, ...], tuple[np.ndarray, ...], np.ndarray | None], tuple]


def frame_pairs(frames: DataFrame, row: str = "row_id", block: int = 64) -> DataFrame:
    """(first, second, gap): each unordered pair of frames once, by an equi-join of blocks."""
    ids = frames.select(F.col(row).cast("long").alias("r")).distinct().withColumn("b", F.floor(F.col("r") / block))
    blocks = F.broadcast(ids.select("b").distinct().agg(F.sort_array(F.collect_list("b")).alias("all")))  # one row; the pairs are the square of its length
    dealt = ids.join(blocks, F.lit(True)).withColumn("p", F.explode("all"))
    side = lambda row, own: dealt.select(F.col("r").alias(row), F.least("b", "p").alias("lo"), F.greatest("b", "p").alias("hi"), F.col("b").alias(own))
    a, b = side("first", "ba"), side("second", "bb")
    pairs = a.join(b, ["lo", "hi"]).where((F.col("first") < F.col("second")) & F.when(F.col("lo") == F.col("hi"), True).otherwise(F.col("ba") != F.col("bb")))
    return pairs.select("first", "second", (F.col("second") - F.col("first")).alias("gap"))


def mutual_cosine(min_similarity: float = 0.8) -> Matcher:
    """Mutual best cosine; zero vectors have no match and exact ties are rejected. Distances are of the raw vectors."""

    def match(a: np.ndarray, b: np.ndarray) -> Matches:
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        left, right = np.flatnonzero(na > 0), np.flatnonzero(nb > 0)
        if not len(left) or not len(right):
            return NONE
        s = np.clip((a[left] / na[left, None]) @ (b[right] / nb[right, None]).T, -1, 1)
        to, back = s.argmax(1), s.argmax(0)
        best = s[np.arange(len(left)), to]
        unique = (s == best[:, None]).sum(1) == 1
        unique &= (s == s.max(0)[None]).sum(0)[to] == 1
        keep = np.flatnonzero((back[to] == np.arange(len(left))) & unique & (best >= min_similarity))
        i, j = left[keep], right[to[keep]]
        return i, j, best[keep], np.linalg.norm(a[i] - b[j], axis=1)

    def prepare(rows: np.ndarray) -> tuple[np.ndarray, ...]:
        size = np.linalg.norm(rows, axis=1)
        return rows / np.where(size > 0, size, 1.0)[:, None], size > 0

    def stacked(own: tuple[np.ndarray, ...], others: tuple[np.ndarray, ...], missing: np.ndarray | None) -> tuple:
        k, m = others[1].shape
        s = own[0] @ others[0].reshape(k * m, -1).T
        s = np.clip(s, -1, 1, out=s).reshape(-1, k, m)
        dead = ~others[1] if missing is None else ~others[1] | missing
        if dead.any():
            s[:, dead] = -2
        if not own[1].all():
            s[~own[1]] = -2
        to, columns = s.argmax(2), s.max(0)
        best = np.take_along_axis(s, to[..., None], 2)[..., 0]
        i, f = np.nonzero((best >= columns[np.arange(k), to] - CLOSE) & (best >= max(min_similarity, -1) - CLOSE))
        j, best = to[i, f], best[i, f]
        near = ((s[i, f] >= best[:, None] - CLOSE).sum(1) > 1) | ((s[:, f, j] >= best - CLOSE).sum(0) > 1) | (best <= min_similarity + CLOSE)
        clear = np.ones(k, bool)
        clear[f[near]] = False
        i, f, j = (x[clear[f]] for x in (i, f, j))
        return f, i, j, np.clip(np.einsum("cx,cx->c", own[0][i], others[0][f, j]), -1, 1), None, np.flatnonzero(~clear)

    match.stacked = Stacked(prepare, stacked)
    return match


def mutual_ratio(ratio: float = 0.8) -> Matcher:
    """Mutual nearest neighbours that pass the distance ratio both ways, strictly; needs two rows on each side."""

    def match(a: np.ndarray, b: np.ndarray) -> Matches:
        if len(a) < 2 or len(b) < 2:
            return NONE
        d = np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)
        to, back = d.argmin(1), d.argmin(0)
        near, near_back = np.sort(np.partition(d, 1, axis=1)[:, :2], axis=1), np.sort(np.partition(d, 1, axis=0)[:2], axis=0)
        own = np.arange(len(a))
        keep = np.flatnonzero((back[to] == own) & (near[:, 0] < ratio * ratio * near[:, 1]) & (near_back[0, to] < ratio * ratio * near_back[1, to]))
        i, j = own[keep], to[keep]
        with np.errstate(invalid="ignore", divide="ignore"):
            worst = np.maximum(near[i, 0] / near[i, 1], near_back[0, j] / near_back[1, j])
        return i, j, 1 - np.sqrt(worst), np.sqrt(d[i, j])

    def stacked(own: tuple[np.ndarray, ...], others: tuple[np.ndarray, ...], missing: np.ndarray | None) -> tuple:
        (a, aa), (b, bb) = own, others
        k, m = bb.shape
        if len(a) < 2 or m < 2:
            return NONE[0], *NONE, NONE[0]
        d = a @ b.reshape(k * m, -1).T
        d *= -2
        d += aa[:, None] + bb.reshape(-1)
        d = np.maximum(0, d, out=d).reshape(-1, k, m)
        if missing is not None:
            d[:, missing] = np.inf
        to, columns = d.argmin(2), d.min(0)
        best = np.take_along_axis(d, to[..., None], 2)[..., 0]
        i, f = np.nonzero(best <= columns[np.arange(k), to] + CLOSE)
        if missing is not None:
            i, f = (x[(~missing).sum(1)[f] >= 2] for x in (i, f))
        j, best, each = to[i, f], best[i, f], np.arange(len(i))
        rows, back = d[i, f], d[:, f, j]  # copies: the second best is the best of the others
        rows[each, j] = back[i, each] = np.inf
        right, left = rows.argmin(1), back.argmin(0)
        second = np.minimum(rows[each, right], back[left, each])
        near = (np.abs(best - ratio * ratio * second) <= CLOSE) | ((best < ratio * ratio * second) & (second - best <= CLOSE))
        clear = np.ones(k, bool)
        clear[f[near]] = False
        keep = np.flatnonzero(clear[f] & (best < ratio * ratio * second))
        i, f, j, left, right = i[keep], f[keep], j[keep], left[keep], right[keep]
        off = lambda x, y, z: np.maximum(0, aa[x] + bb[y, z] - 2 * np.einsum("cx,cx->c", a[x], b[y, z]))
        best = off(i, f, j)
        return f, i, j, 1 - np.sqrt(np.maximum(best / off(i, f, right), best / off(left, f, j))), np.sqrt(best), np.flatnonzero(~clear)

    match.stacked = Stacked(lambda rows: (rows, (rows * rows).sum(1)), stacked)
    return match


def mutual_cosine_ratio(ratio: float = 0.8) -> Matcher:
    """Mutual best cosine whose distance 1 - cosine is, both ways, below ratio times the second best's; zero vectors have no match."""

    def match(a: np.ndarray, b: np.ndarray) -> Matches:
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        left, right = np.flatnonzero(na > 0), np.flatnonzero(nb > 0)
        if len(left) < 2 or len(right) < 2:
            return NONE
        d = 1 - np.clip((a[left] / na[left, None]) @ (b[right] / nb[right, None]).T, -1, 1)
        rows, columns = np.sort(d, axis=1)[:, :2], np.sort(d, axis=0)[:2]
        to, own = d.argmin(1), np.arange(len(left))
        keep = np.flatnonzero((d.argmin(0)[to] == own) & (rows[:, 0] < ratio * rows[:, 1]) & (columns[0, to] < ratio * columns[1, to]))
        i, j = left[keep], right[to[keep]]
        return i, j, 1 - d[keep, to[keep]], np.linalg.norm(a[i] - b[j], axis=1)

    return match


def match_pairs(features: DataFrame, pairs: DataFrame, matcher: Matcher) -> DataFrame:
    """EDGES of the listed pairs (first, second) of frames alone; a frame is copied once for each of its pairs.

    Features whose column ``masked`` is true, if there is one, take no part.
    """
    rows = features.where("descriptor is not null")
    rows = rows.where("not coalesce(masked, false)") if "masked" in features.columns else rows
    rows = rows.select(F.col("row_id").cast("long").alias("row_id"), F.col("feature_id").cast("long").alias("feature_id"), "descriptor")
    asked = pairs.select(F.col("first").cast("long"), F.col("second").cast("long")).distinct()
    sides = asked.select("first", "second", F.explode(F.array("first", "second")).alias("row_id")).join(rows, "row_id")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        sides = [group[group["row_id"] == k].sort_values("feature_id") for k in key]
        if not all(map(len, sides)):
            return pd.DataFrame({c.split()[0]: [] for c in EDGES.split(", ")})
        i, j, score, distance = matcher(*(np.array(s["descriptor"].tolist(), float) for s in sides))
        return pd.DataFrame({"first": key[0], "second": key[1], "left_id": sides[0]["feature_id"].to_numpy()[i], "right_id": sides[1]["feature_id"].to_numpy()[j], "score": score, "distance": distance})

    return sides.groupBy("first", "second").applyInPandas(run, EDGES)


#: Features of the two blocks that a task holds, at most about.
GROUP_FEATURES = 65_536


def block_of(features: DataFrame) -> int:
    """Frames to a block: as many as a task can hold, for each frame is copied once for every block, but pairs of blocks for every core six times."""
    n = features.agg(F.min("row_id").alias("a"), F.max("row_id").alias("b"), F.count(F.lit(1)).alias("n")).first()
    frames = (n["b"] - n["a"] + 1) if n["n"] else 1
    cores = features.sparkSession.sparkContext.defaultParallelism
    held = GROUP_FEATURES * frames // (2 * max(1, n["n"]))
    return max(1, min(held, -(-frames // -(-int((12 * cores) ** 0.5 * 1000) // 1000))))


def _stacks(sizes: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of frames of these sizes that are stacked: some STACK_SCORES scores against so many rows, at most half of the stack padding."""
    at = 0
    while at < len(sizes):
        end = min(len(sizes), at + max(1, STACK_SCORES // max(1, rows * int(sizes[at]))))
        part = sizes[at:end]
        widest = np.maximum.accumulate(part) * np.arange(1, len(part) + 1)
        fits = (widest * rows <= STACK_SCORES) & (widest <= 2 * np.cumsum(part))
        end = at + max(1, len(part) if fits.all() else int(fits.argmin()))
        yield at, end
        at = end


class _Block:
    """A block's frames in order: their ids, and their features behind each other."""

    def __init__(self, row: np.ndarray, feature: np.ndarray, matrix: np.ndarray, prepare: Callable | None) -> None:
        order = np.lexsort((feature, row))
        self.feature, self.matrix = feature[order], matrix[order]
        self.ids, self.start, self.size = np.unique(row[order], return_index=True, return_counts=True)
        self.ready = prepare(self.matrix) if prepare else ()

    def rows(self, low: int, high: int) -> slice:
        return slice(self.start[low], self.start[high - 1] + self.size[high - 1])

    def stack(self, low: int, high: int) -> tuple[tuple[np.ndarray, ...], np.ndarray | None]:
        """What was prepared for the frames from low to before high, (frames, rows, ...), and which of the rows are padding."""
        size, rows = self.size[low:high], self.rows(low, high)
        if (size == size[0]).all():
            return tuple(x[rows].reshape(len(size), size[0], *x.shape[1:]) for x in self.ready), None
        place = np.arange(size.max())
        at = np.minimum(self.start[low:high, None] + place, self.start[low:high, None] + size[:, None] - 1)
        return tuple(x[at] for x in self.ready), place >= size[:, None]


def block_matches(first: _Block, second: _Block, matcher: Matcher, distances: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """(first, second, left row, right row, score, distance) of every pair of a frame of one block and a later one of the other, which may be the same; rows are counted in the block."""
    stacked: Stacked | None = getattr(matcher, "stacked", None)
    for k, frame in enumerate(first.ids):
        own = first.rows(k, k + 1)
        since = int(np.searchsorted(second.ids, frame, side="right"))
        ready = tuple(x[own] for x in first.ready)
        for low, high in _stacks(second.size[since:], int(first.size[k])) if stacked else ((x, x + 1) for x in range(len(second.ids) - since)):
            low, high = low + since, high + since
            again = np.arange(low, high)
            if stacked:
                f, i, j, score, distance, close = stacked.match(ready, *second.stack(low, high))
                at, left, again = second.start[low + f] + j, own.start + i, low + close
                if distance is None:
                    distance = np.linalg.norm(first.matrix[left] - second.matrix[at], axis=1) if distances else np.zeros(len(f))
                yield np.full(len(f), frame), second.ids[low + f], left, at, score, distance
            for x in again:
                its = second.rows(x, x + 1)
                i, j, score, distance = matcher(first.matrix[own], second.matrix[its])
                yield np.full(len(i), frame), np.full(len(i), second.ids[x]), own.start + i, its.start + j, score, distance


def _batches(parts: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Parts of few rows as batches of many."""
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += len(part[0])
        if rows >= BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
            held, rows = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)


def _read_block_pair(batches: Iterator[pa.RecordBatch], prepare: Callable | None) -> list[_Block]:
    """The one or two blocks, in order, of a group's rows (row_id, feature_id, descriptor, b)."""
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for batch in batches:
        if batch.num_rows:
            for name, held in zip(("row_id", "feature_id", "b"), columns, strict=False):
                held.append(batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64))
            values = batch.column("descriptor")
            columns[3].append(values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1))
    row, feature, block, matrix = (np.concatenate(c) for c in columns)
    return [_Block(row[block == b], feature[block == b], matrix[block == b], prepare) for b in np.unique(block)]


def _block_pairs(features: DataFrame, block: int | None) -> DataFrame:
    """Features with b, the block of their frame, once for each pair of blocks (lo, hi) that holds it."""
    block = block or block_of(features.select(F.col("row_id").cast("long").alias("row_id")))
    rows = features.where("descriptor is not null").select(F.col("row_id").cast("long").alias("row_id"), F.col("feature_id").cast("long").alias("feature_id"), F.col("descriptor").cast("array<double>").alias("descriptor"))
    rows = rows.withColumn("b", F.floor(F.col("row_id") / block))
    blocks = F.broadcast(rows.select("b").distinct().agg(F.sort_array(F.collect_list("b")).alias("all")))
    return rows.join(blocks, F.lit(True)).withColumn("p", F.explode("all")).select("row_id", "feature_id", "descriptor", "b", F.least("b", "p").alias("lo"), F.greatest("b", "p").alias("hi"))


def _over_block_pairs(features: DataFrame, matcher: Matcher, block: int | None, schema: str, work: Callable[[_Block, _Block], Iterator[tuple[np.ndarray, ...]]]) -> DataFrame:
    """What work yields for each pair of blocks, columns of schema, in batches."""
    names = [c.split()[0] for c in schema.split(", ")]
    prepare = matcher.stacked.prepare if hasattr(matcher, "stacked") else None

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _read_block_pair(batches, prepare)
        if key[0] == key[1] or len(blocks) == 2:
            yield from _batches(work(blocks[0], blocks[-1]), names)

    return _block_pairs(features, block).groupBy("lo", "hi").applyInArrow(run, schema)


def match_frames(features: DataFrame, matcher: Matcher, block: int | None = None) -> DataFrame:
    """match_edges of every pair of frames of features (row_id, feature_id, descriptor).

    A matcher is any function of two float matrices; those with an attribute stacked match a frame
    with many at once. Null descriptors are left out. A block has so many frames (block_of where it is not given).
    A task holds its two blocks and a batch of edges.
    """

    def work(first: _Block, second: _Block) -> Iterator[tuple[np.ndarray, ...]]:
        for one, other, i, j, score, distance in block_matches(first, second, matcher):
            yield one, other, first.feature[i], second.feature[j], score, distance

    return _over_block_pairs(features, matcher, block, EDGES, work)


def match_totals(features: DataFrame, matcher: Matcher, block: int | None = None) -> DataFrame:
    """TOTALS of match_frames, the number of matches and the sum of their scores of each pair of frames that has any: a pair is one task's, so no match is a row."""

    def work(first: _Block, second: _Block) -> Iterator[tuple[np.ndarray, ...]]:
        for one, other, _, _, score, _ in block_matches(first, second, matcher, distances=False):
            if len(one):
                ids, at, n = np.unique(other, return_inverse=True, return_counts=True)
                yield np.full(len(ids), one[0]), ids, n, np.bincount(at, score)

    return _over_block_pairs(features, matcher, block, TOTALS, work)


def most_similar(frames: DataFrame, keep: int, gap: int, block: int = 256) -> DataFrame:
    """(row_id, candidate, similarity, rank): the ``keep`` frames at least gap before each frame that are most like it.

    frames has row_id and g, a descriptor of the frame. Frames meet in pairs of blocks, as in
    match_frames; a block gives a frame its best ``keep`` only, so pairs are never rows.
    Similarities are rounded to nine digits, ties go to the lower candidate, and frames whose
    descriptor is zero or null take no part.
    """
    rows = frames.where("g is not null").select(F.col("row_id").cast("long").alias("row_id"), "g").withColumn("b", F.floor(F.col("row_id") / block))
    blocks = F.broadcast(rows.select("b").distinct().agg(F.sort_array(F.collect_list("b")).alias("all")))
    planned = rows.join(blocks, F.lit(True)).withColumn("p", F.explode("all")).select("row_id", "g", "b", F.least("b", "p").alias("lo"), F.greatest("b", "p").alias("hi"))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row_id")
        units = np.array(group["g"].tolist(), float)
        size = np.linalg.norm(units, axis=1)
        group, units = group[size > 0], units[size > 0] / size[size > 0, None]
        late, early = (np.flatnonzero(group["b"] == k) for k in (key[1], key[0]))
        ids = group["row_id"].to_numpy()
        if not len(late) or not len(early):
            return pd.DataFrame({"row_id": [], "candidate": [], "similarity": []})
        score = np.round(np.clip(units[late] @ units[early].T, -1, 1), 9)
        score[ids[early][None] > ids[late][:, None] - gap] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, :keep]
        found = np.take_along_axis(score, best, 1)
        at, k = np.nonzero(found > -np.inf)
        return pd.DataFrame({"row_id": ids[late[at]], "candidate": ids[early[best[at, k]]], "similarity": found[at, k]})

    found = planned.groupBy("lo", "hi").applyInPandas(run, "row_id long, candidate long, similarity double")
    w = Window.partitionBy("row_id").orderBy(F.desc("similarity"), "candidate")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def best_two(scored: DataFrame, by: list[str], similarity: str, order: str) -> DataFrame:
    """The best and second-best similarity of each group, ties to the lower ``order``: (by, best, best_id, second)."""
    w = Window.partitionBy(*by).orderBy(F.desc(similarity), order)
    ranked = scored.withColumn("n", F.row_number().over(w)).where("n <= 2")
    return ranked.groupBy(*by).agg(F.max(F.when(F.col("n") == 1, F.col(similarity))).alias("best"), F.max(F.when(F.col("n") == 1, F.col(order))).alias("best_id"), F.max(F.when(F.col("n") == 2, F.col(similarity))).alias("second"))


def accepted(best: Column, second: Column, min_similarity: float, min_margin: float) -> Column:
    """The similarity and margin test; without a second the margin is infinite."""
    return (best >= min_similarity) & (second.isNull() | (best - second >= min_margin))


def radius_join(a: DataFrame, b: DataFrame, radius: float, by: list[str], cost: Column | None = None, keep: int = 8) -> DataFrame:
    """Rows of a with the rows of b within radius, the ``keep`` cheapest each by (cost, b_id).

    a has a_id, ax, ay and b has b_id, bx, by; ``by`` are equality keys. Points are put in
    cells of the radius' size; b is copied to the nine cells around it, so the join is an
    equi-join of neighbouring cells. The default cost is the squared distance over radius^2.
    """
    cell = lambda c, d: (F.floor(F.col(c) / radius) + d).cast("long")
    left = a.withColumn("_cx", cell("ax", 0)).withColumn("_cy", cell("ay", 0))
    shifts = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1))))
    right = b.withColumn("_s", shifts).withColumn("_cx", cell("bx", F.col("_s.x"))).withColumn("_cy", cell("by", F.col("_s.y"))).drop("_s")
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    near = left.join(right, [*by, "_cx", "_cy"]).withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= radius * radius)
    near = near.withColumn("cost", cost if cost is not None else F.col("d2") / (radius * radius))
    w = Window.partitionBy(*by, "a_id").orderBy("cost", "b_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).drop("_cx", "_cy")


def mutual_best(scored: DataFrame, by: list[str], left: str, right: str, similarity: str) -> DataFrame:
    """Pairs that are each other's best, ties to the lower id on either side."""
    a = Window.partitionBy(*by, left).orderBy(F.desc(similarity), right)
    b = Window.partitionBy(*by, right).orderBy(F.desc(similarity), left)
    return scored.withColumn("_l", F.row_number().over(a)).withColumn("_r", F.row_number().over(b)).where("_l = 1 and _r = 1").drop("_l", "_r")

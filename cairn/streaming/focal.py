"""The focal estimator over streams of tracked frames: which pairs to take, in order, and keyed state for their sums.

``session_pairs`` finds a session's pairs in one ordered pass that holds at most the frames of
the longest gap; the fits of all pairs then run in parallel (``operators.focal``). The stream
keeps, for each session, the same window, the sums of the grid and the counts as variables of
their own in keyed state; a restart of the tracks empties the window alone, a reset all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cairn.operators.focal import Grid, fit_pair

#: Events of a session at one frame number are handled in this order: reset, restart, frame.
EVENTS = ("reset", "restart", "frame")
OUTPUT = "session long, first long, second long, status string, fitted long, used long, weak long, homography long, flat long, k1 double, hfov double, focal double, residuals array<double>, costs array<double>"


class Window:
    """The frames among which the next pair's first one is looked for."""

    def __init__(self, width: int, grid: Grid) -> None:
        self.width, self.grid = width, grid
        self.frames: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.last: int | None = None

    def restart(self) -> None:
        self.frames, self.last = [], None

    def add(self, frame: int, ids: np.ndarray, points: np.ndarray) -> tuple[int, np.ndarray, np.ndarray] | None:
        """(first, its points, this frame's points) of the latest earlier frame that moved enough, if a pair is due; an earlier frame with too few common tracks ends the search."""
        g, found = self.grid, None
        while self.frames and not frame - g.max_gap <= self.frames[0][0] < frame:
            self.frames.pop(0)
        if self.last is None or frame >= self.last + g.pair_stride:
            for first, known, before in reversed(self.frames):
                _, i, j = np.intersect1d(known, ids, assume_unique=True, return_indices=True)
                if len(i) < g.min_common:
                    break
                moved = np.linalg.norm(points[j] - before[i], axis=1)
                if np.partition(moved, len(moved) // 2)[len(moved) // 2] >= g.min_displacement * self.width:
                    found, self.last = (first, before[i], points[j]), frame
                    break
        self.frames.append((frame, ids, points))
        return found


def _frames(rows: pd.DataFrame) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    """(frame, kind, ids, points) in order; of a track that a frame repeats the first row by position counts."""
    rows = rows.assign(rank=rows["kind"].map(EVENTS.index)).sort_values(["frame", "rank", "track_id", "x", "y"], kind="stable")
    for (frame, rank), own in rows.groupby(["frame", "rank"], sort=True):
        own = own.drop_duplicates("track_id")
        yield int(frame), EVENTS[rank], own["track_id"].to_numpy(), own[["x", "y"]].to_numpy(float)


def session_pairs(observations: DataFrame, width: int, grid: Grid | None = None) -> DataFrame:
    """(session, first, second, x1, y1, x2, y2): the matches of the pairs that each session takes.

    observations: (session, frame, kind, track_id, x, y); kind is 'frame', or 'restart' or 'reset' in
    a row without a track, which comes before the frame of its number. Rows without a session, frame or (for frames) finite
    position and track are left out. A session is sequential and goes through one task in order.
    """
    grid = grid or Grid()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window, session, waiting = None, None, []

        def step() -> pd.DataFrame | None:
            out = []
            for frame, kind, ids, points in _frames(pd.concat(waiting)):
                if kind != "frame":
                    window.restart()
                elif found := window.add(frame, ids, points):
                    first, a, b = found
                    out.append(pd.DataFrame({"session": session, "first": first, "second": frame, "x1": a[:, 0], "y1": a[:, 1], "x2": b[:, 0], "y2": b[:, 1]}))
            return pd.concat(out) if out else None

        for batch in batches:
            for (own, frame), rows in batch.groupby(["session", "frame"], sort=False):
                if waiting and (own, frame) != (session, waiting[0]["frame"].iloc[0]):
                    if (made := step()) is not None:
                        yield made
                    waiting = []
                if own != session:
                    window, session = Window(width, grid), own
                waiting.append(rows)
        if waiting and (made := step()) is not None:
            yield made

    rows = _valid(observations).repartition("session").sortWithinPartitions("session", "frame")
    return rows.mapInPandas(run, "session long, first long, second long, x1 double, y1 double, x2 double, y2 double")


def _valid(observations: DataFrame) -> DataFrame:
    rows = observations.select(F.col("session").cast("long"), F.col("frame").cast("long"), "kind", F.col("track_id").cast("long"), F.col("x").cast("double"), F.col("y").cast("double"))
    seen = F.col("track_id").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    rows = rows.where(F.col("session").isNotNull() & F.col("frame").isNotNull() & F.col("kind").isin(*EVENTS) & ((F.col("kind") != "frame") | seen))
    return rows.withColumn("track_id", F.coalesce("track_id", F.lit(-1)))


def _minimum(grid: tuple[float, ...], costs: np.ndarray) -> float:
    k = int(np.argmin(costs))
    if 0 < k < len(grid) - 1 and (bend := costs[k - 1] - 2 * costs[k] + costs[k + 1]) > 0:
        return grid[k] + float(np.clip((costs[k - 1] - costs[k + 1]) / (2 * bend), -1, 1)) * (grid[1] - grid[0])
    return grid[k]


def curves_of(matrices: list, grid: Grid) -> np.ndarray:
    """(k1, fields of view): the relative gap of the two singular values of every matrix at every focal length."""
    f = 0.5 / np.tan(np.radians(np.array(grid.hfovs)) / 2)
    scale = np.stack([f, f, np.ones_like(f)], 1)
    m = np.array([np.full(9, np.nan) if x is None else x for x in matrices]).reshape(-1, 1, 3, 3)
    e = scale[None, :, :, None] * m * scale[None, :, None, :]
    square = (e * e).sum((2, 3))
    cofactors = np.cross(e[:, :, [1, 2, 0]], e[:, :, [2, 0, 1]])
    twice = 2 * np.sqrt((cofactors * cofactors).sum((2, 3)))
    with np.errstate(all="ignore"):
        return np.where(square + twice > 0, np.sqrt(np.maximum(square - twice, 0) / (square + twice)), 1.0)


class FocalState(StatefulProcessor):
    """Window, counts and sums of a session."""

    def __init__(self, width: int, height: int, grid: Grid) -> None:
        self.width, self.height, self.grid = width, height, grid

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getMapState("window", "frame long", "ids array<long>, points array<double>")
        self.last = handle.getValueState("last", "frame long, pair long")
        self.counts = handle.getValueState("counts", "fitted long, used long, weak long, homography long, flat long")
        self.sums = handle.getValueState("sums", "residuals array<double>, costs array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        g, window = self.grid, Window(self.width, self.grid)
        held = {k[0]: (np.array(v[0], np.int64), np.array(v[1], float).reshape(-1, 2)) for k, v in self.window.iterator()}
        window.frames = [(k, *held[k]) for k in sorted(held)]
        latest, window.last = self.last.get() if self.last.exists() else (None, None)
        counts = dict(zip(("fitted", "used", "weak", "homography", "flat"), self.counts.get() if self.counts.exists() else (0,) * 5, strict=True))
        residuals, costs = (np.array(x, float) for x in (self.sums.get() if self.sums.exists() else ([0.0] * len(g.k1s), [0.0] * len(g.k1s) * len(g.hfovs))))
        out = []
        for frame, kind, ids, points in _frames(pd.concat(list(rows))):
            if latest is not None and frame < latest:
                raise ValueError(f"session {key[0]}: frame {frame} came after frame {latest}")
            latest = frame
            if kind != "frame":
                window.restart()
                if kind == "reset":
                    counts, residuals, costs = dict.fromkeys(counts, 0), residuals * 0, costs * 0
                continue
            if (found := window.add(frame, ids, points)) is None:
                continue
            first, a, b = found
            order = np.lexsort((b[:, 1], b[:, 0], a[:, 1], a[:, 0]))
            fit = fit_pair([int(key[0]), first, frame], a[order], b[order], self.width, self.height, g)
            status = fit["status"]
            if status == "fitted":
                own = curves_of(fit["matrices"], g)
                best = own[int(np.argmin(fit["residuals"]))]
                status = "flat" if best.max() - best.min() < g.min_curve_depth else "used"
                counts["fitted"] += 1
                residuals = residuals + fit["residuals"]
                costs = costs + (own.ravel() if status == "used" else 0)
            counts[status] += 1
            out.append({"session": key[0], "first": first, "second": frame, "status": status, **counts, **self.estimate(counts, residuals, costs), "residuals": residuals.tolist(), "costs": costs.tolist()})
        kept = {f[0] for f in window.frames}
        for gone in set(held) - kept:
            self.window.removeKey((gone,))
        for frame, ids, points in window.frames:
            if frame not in held:
                self.window.updateValue((frame,), (ids.tolist(), points.ravel().tolist()))
        self.last.update((latest, window.last))
        self.counts.update(tuple(counts.values()))
        self.sums.update((residuals.tolist(), costs.tolist()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def estimate(self, counts: dict, residuals: np.ndarray, costs: np.ndarray) -> dict:
        g = self.grid
        if not counts["used"]:
            return {"k1": None, "hfov": None, "focal": None}
        k1 = _minimum(g.k1s, np.sqrt(residuals / counts["fitted"]))
        place = float(np.clip((k1 - g.k1s[0]) / (g.k1s[1] - g.k1s[0] if len(g.k1s) > 1 else 1.0), 0, len(g.k1s) - 1))
        row, table = int(place), costs.reshape(len(g.k1s), -1) / counts["used"]
        hfov = _minimum(g.hfovs, (1 - place + row) * table[row] + (place - row) * table[min(row + 1, len(g.k1s) - 1)])
        return {"k1": k1, "hfov": hfov, "focal": 0.5 * self.width / float(np.tan(np.radians(hfov) / 2))}

    def close(self) -> None:
        pass


def focal_stream(observations: DataFrame, width: int, height: int, grid: Grid | None = None) -> DataFrame:
    """OUTPUT of a stream of observations as in ``session_pairs``: a row for each pair that is judged, with the session's counts, estimate and sums after it.

    Frames of a session must arrive in order, whatever the cut into batches; an earlier one is an error. Needs the RocksDB state store.
    """
    return _valid(observations).groupBy("session").transformWithStateInPandas(FocalState(width, height, grid or Grid()), OUTPUT, "Append", "None")

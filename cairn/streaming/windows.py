"""Event-time windows over streams; the watermark is an addition, order is otherwise an error."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cairn.operators import voxels


def sliding_counts(stream: DataFrame, time: str, by: list[str], value: str, width: str, slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """(start, end, by, n, total) of tumbling or sliding windows; rows later than the watermark are dropped by Spark."""
    windows = stream.withWatermark(time, lateness).groupBy(F.window(time, width, slide or width).alias("w"), *by)
    return windows.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def session_counts(stream: DataFrame, time: str, by: list[str], gap: str, lateness: str = "10 minutes") -> DataFrame:
    """(start, end, by, n) of sessions that end after a gap."""
    sessions = stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("w"), *by)
    return sessions.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def voxel_stream(samples: DataFrame, voxel: float) -> DataFrame:
    """Running sums per voxel of a stream of samples (segment, x, y, z, weight, distance), for complete or update mode."""
    cells = samples.select("segment", *(F.floor(F.col(a) / voxel).cast("long").alias(f"i{a}") for a in "xyz"), "weight", "distance")
    return cells.groupBy("segment", "ix", "iy", "iz").agg(F.sum("weight").alias("weight"), (F.sum(F.col("weight") * F.col("distance")) / F.sum("weight")).alias("distance"))


#: Cells to a side of a brick, the key of the voxel stream's state.
BRICK = 8
VOXELS = "session long, segment long, ix long, iy long, iz long, weight double, distance double, rays long"


class BrickState(StatefulProcessor):
    """A brick's sums: the segment they are of and, by cell, weight, weighted distance and rays."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.segment = handle.getValueState("segment", "segment long")
        self.cells = handle.getMapState("cells", "ix long, iy long, iz long", "w double, wd double, rays long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows))
        latest = self.segment.get()[0] if self.segment.exists() else None
        newest = int(frame["segment"].max())
        if latest is None or newest > latest:
            if latest is not None:
                self.cells.clear()  # a later segment is a reset: nothing of the one before is kept
            self.segment.update((newest,))
            latest = newest
        own = frame[frame["segment"] == latest]
        out = []
        for cell, w, wd, n in own.groupby(["ix", "iy", "iz"]).agg(w=("w", "sum"), wd=("wd", "sum"), n=("w", "size")).itertuples():
            cell = tuple(map(int, cell))
            before = self.cells.getValue(cell) if self.cells.containsKey(cell) else (0.0, 0.0, 0)
            now = (before[0] + float(w), before[1] + float(wd), before[2] + int(n))
            self.cells.updateValue(cell, now)
            out.append((int(key[0]), latest, *cell, now[0], now[1] / now[0] if now[0] else None, now[2]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in VOXELS.split(", ")])

    def close(self) -> None:
        pass


def voxel_ray_stream(samples: DataFrame, voxel: float, truncation: float) -> DataFrame:
    """VOXELS of a stream of samples (session, segment, px, py, pz, ox, oy, oz, weight): the running sums of each cell that a batch changes.

    Rays are walked in the tasks that read them. The cells' bricks are the key of the state; the first sample of a later segment that a brick
    meets clears it, and late samples of a segment that is over are dropped, so segments never mix; a reader takes the rows of the session's last segment. Needs the RocksDB state store.
    """
    cells = voxels.ray_samples(samples, ["session", "segment"], voxel, truncation)
    brick = [F.floor(F.col(c) / BRICK).cast("long").alias(f"b{c[1]}") for c in ("ix", "iy", "iz")]
    keyed = cells.where("session is not null and segment is not null").select("*", *brick)
    return keyed.groupBy("session", "bx", "by", "bz").transformWithStateInPandas(BrickState(), VOXELS, "Append", "None")

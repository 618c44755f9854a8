"""Near-duplicate vectors by lattice hashing, verified by cosine in double precision.

Clusters. Copies would make every bucket quadratic, so vectors are first gathered into
clusters with a centre and a radius (an angle): within a batch as it is read, then again
among the centres of one lattice cell. A radius of at most half the threshold angle proves
that all members link with each other, so a cluster needs no pairs of its own.

Hashing. Each table projects a vector with ``BLOCKS`` random orthonormal blocks of eight
dimensions, shifts and scales it and decodes each block to the nearest point of the E8
lattice; the points' hash is the home cell. Of the cells reached by replacing a point with
one of its nearest neighbours, the ``PROBES`` with the least extra distance are probed. Two
clusters are candidates if a home cell of one is a home or probed cell of the other; a
64-bit sign sketch drops most chance meetings of single vectors first. At a cosine of
exactly 0.9 a table finds a pair with probability 0.45, all ``TABLES`` with 0.999 (0.9999
at 0.93).

Verifying. For centres at angle a with radii r and s: if a + r + s is within the threshold
angle all members link, if a - r - s is beyond it none do; otherwise the members are
compared, in chunks of bounded size, and only counts leave the task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.components import connected_components
from cairn.session import checkpoint

MIN_COSINE = 0.9
TABLES = 12
BLOCKS = 3
PROBES = 12
#: Cell size as a multiple of a linked pair's expected distance within a block.
WIDTH = 2.2
NEIGHBOURS = 4
BATCH = 2048
CHUNK = 256
#: Most bits in which the sketches of a linked pair may differ; 9 are expected at cosine 0.9, with a deviation of 2.8.
SKETCH_BITS = 24
SEED = 11


def _d8(x: np.ndarray) -> np.ndarray:
    """The nearest point of D8: round, and where the sum is odd round the worst coordinate the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def e8_nearest(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the union of D8 and D8 shifted by one half, to each row."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache
def _e8_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [(i, j, s, t) for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    whole = np.zeros((len(pairs), 8))
    for row, (i, j, s, t) in enumerate(pairs):
        whole[row, i], whole[row, j] = s, t
    half = np.array([x for x in itertools.product((0.5, -0.5), repeat=8) if sum(v < 0 for v in x) % 2 == 0])
    return np.vstack([whole, half])


@lru_cache
def _projections(dims: int, tables: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(dims x tables*blocks*8 projections, shifts, hash multipliers, sketch directions)."""
    rng = np.random.default_rng([SEED, dims])
    need, parts = tables * blocks * 8, []
    while sum(p.shape[1] for p in parts) < need:
        parts.append(np.linalg.qr(rng.normal(size=(dims, dims)))[0])
        whole = max(8, dims // (8 * blocks) * 8 * blocks)
        parts[-1] = parts[-1][:, :whole] if dims >= 8 * blocks else rng.normal(size=(dims, 8 * blocks)) / np.sqrt(dims)
    multipliers = rng.integers(1, 1 << 62, size=need, dtype=np.int64) | 1
    return np.hstack(parts)[:, :need], rng.random(need) * 4, multipliers, rng.normal(size=(dims, 64))


def lattice_cells(units: np.ndarray, min_cosine: float = MIN_COSINE, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES) -> np.ndarray:
    """(rows, tables, 1 + probes) cell hashes of unit vectors; the first is the home cell."""
    n, dims = units.shape
    matrix, shift, multipliers, _ = _projections(dims, tables, blocks)
    scale = WIDTH * np.sqrt(8 * (2 - 2 * min_cosine) / dims)
    x = units @ matrix / scale + shift
    combos = np.array([c for c in itertools.product(range(NEIGHBOURS + 1), repeat=blocks) if sum(v > 0 for v in c) <= 2])
    vectors = _e8_vectors()
    out = np.zeros((n, tables, 1 + probes), np.int64)
    with np.errstate(over="ignore"):
        for t in range(tables):
            costs, hashes = np.zeros((n, len(combos))), np.zeros((n, len(combos)), np.int64)
            for b in range(blocks):
                at = slice(8 * (t * blocks + b), 8 * (t * blocks + b + 1))
                home = e8_nearest(x[:, at])
                gain = (x[:, at] - home) @ vectors.T
                best = np.argpartition(-gain, NEIGHBOURS, axis=1)[:, :NEIGHBOURS]
                points = np.concatenate([home[:, None], home[:, None] + vectors[best]], axis=1)
                extra = np.concatenate([np.zeros((n, 1)), 2 - 2 * np.take_along_axis(gain, best, 1)], axis=1)
                hashed = ((2 * points).astype(np.int64) * multipliers[at]).sum(-1)
                costs += extra[:, combos[:, b]]
                hashes += hashed[:, combos[:, b]]
            order = np.argsort(costs, axis=1, kind="stable")[:, : 1 + probes]
            out[:, t] = np.take_along_axis(hashes, order, 1) ^ np.int64(t * 0x5851F42D4C957F2D & 0x7FFFFFFFFFFFFFFF)
    return out


def sketches(units: np.ndarray) -> np.ndarray:
    """64 signs of fixed random projections, as a signed long."""
    bits = units @ _projections(units.shape[1], TABLES, BLOCKS)[3] > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between rows, precise for small ones too."""
    return 2 * np.arctan2(np.linalg.norm(a - b, axis=-1), np.linalg.norm(a + b, axis=-1))


def gather(centres: np.ndarray, radii: np.ndarray, counts: np.ndarray, most: float) -> tuple[np.ndarray, list[tuple[np.ndarray, float, int]]]:
    """(label of each cluster, (centre, radius, count) of each label): greedy merging with a radius of at most ``most``."""
    n = len(centres)
    labels, made = np.full(n, -1), []
    for at in range(0, n, BATCH):
        part = slice(at, min(n, at + BATCH))
        c, r, k = centres[part], radii[part], counts[part]
        near = c @ c.T >= np.cos(most)
        free = np.ones(len(c), bool)
        for seed in np.argsort(-near.sum(1), kind="stable"):
            if not free[seed]:
                continue
            own = np.flatnonzero(near[seed] & free)
            if len(own) > 1:
                mean = (c[own] * k[own, None]).sum(0)
                mean /= max(np.linalg.norm(mean), 1e-300)
                reach = angles(c[own], mean) + r[own]
                fits = reach <= most
                if fits.sum() > 1:
                    own, centre, radius = own[fits], mean, float(reach[fits].max())
                    labels[at + own] = len(made)
                    free[own] = False
                    made.append((centre, radius, int(k[own].sum())))
                    if free[seed]:
                        labels[at + seed] = len(made)
                        free[seed] = False
                        made.append((c[seed], float(r[seed]), int(k[seed])))
                    continue
            labels[at + seed] = len(made)
            free[seed] = False
            made.append((c[seed], float(r[seed]), int(k[seed])))
    return labels, made


_CLUSTER = "centre array<double>, radius double, members long, place long"


def _clustered(rows: DataFrame, limit: float, first: bool) -> DataFrame:
    """(id, row, vec, cluster and, in one row of each cluster, its centre, radius, members and place)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 40
        for frame in frames:
            vecs = frame["vec"].tolist()
            sizes = np.array([len(v) for v in vecs])
            for dims in np.unique(sizes):
                rows_at = np.flatnonzero(sizes == dims)
                units = np.array([vecs[i] for i in rows_at], float)
                if first:
                    units /= np.abs(units).max(1)[:, None]  # neither over- nor underflows
                    units /= np.linalg.norm(units, axis=1)[:, None]
                    radii, counts = np.zeros(len(units)), np.ones(len(units), np.int64)
                else:
                    radii, counts = frame["radius"].to_numpy()[rows_at], frame["members"].to_numpy()[rows_at]
                labels, made = gather(units, radii, counts, limit)
                places = lattice_cells(np.array([m[0] for m in made]))[:, 0, 0]
                lead = np.full(len(made), -1)
                lead[labels[::-1]] = np.arange(len(units))[::-1]
                is_lead = lead[labels] == np.arange(len(units))
                pick = lambda values: [values[k] if own else None for k, own in zip(labels, is_lead, strict=True)]  # noqa: E731,B023
                out = pd.DataFrame({"id": frame["id"].to_numpy(dtype=object)[rows_at], "row": frame["row"].to_numpy()[rows_at], "vec": list(units) if first else [None] * len(units), "cluster": base + labels})
                yield out.assign(centre=pick([m[0] for m in made]), radius=pd.array(pick([m[1] for m in made]), "Float64"), members=pd.array(pick([m[2] for m in made]), "Int64"), place=pd.array(pick(places.tolist()), "Int64"))
                base += len(made)

    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, row long, vec array<double>, cluster long, {_CLUSTER}")


def near_duplicate_vectors(vectors: DataFrame, min_cosine: float = MIN_COSINE, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per row of vectors.

    n_links counts the other rows with a cosine of at least min_cosine; repeated rows count
    each. component_id is the smallest id that links reach, itself included; kept marks it.
    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, and neither do vectors of different lengths. Rows with a null id take part;
    their component is the smallest known id. Other columns are ignored; an empty table
    gives no rows.
    """
    threshold = float(np.arccos(min_cosine))
    limit = threshold / 2 * (1 - 1e-9)
    # rows that share an id are told apart by a number, fixed as soon as the clusters are written
    rows = vectors.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.expr("vec is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)")
    alone = rows.where(~finite).select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    first = checkpoint(_clustered(rows.where(finite), limit, first=True))
    centres = first.where("members is not null").select(F.col("cluster").alias("id"), F.col("cluster").alias("row"), F.col("centre").alias("vec"), "radius", "members", "place")
    second = checkpoint(_clustered(centres.repartition("place").sortWithinPartitions("place", "id"), limit, first=False))
    members = checkpoint(first.select("id", "row", "vec", F.col("cluster").alias("inner")).join(second.select(F.col("id").alias("inner"), "cluster"), "inner").drop("inner"))
    clusters = second.where("members is not null").select("cluster", "centre", "radius", F.col("members").alias("n"))

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = frame["vec"].map(len).to_numpy()
            for dims in np.unique(sizes):
                part = frame[sizes == dims]
                for at in range(0, len(part), 1024):
                    own = part.iloc[at : at + 1024]
                    units = np.array(own["vec"].tolist())
                    found = lattice_cells(units, min_cosine, tables, BLOCKS, probes)
                    width = found.shape[1] * found.shape[2]
                    home = np.tile(np.arange(found.shape[2]) == 0, len(own) * found.shape[1])
                    yield pd.DataFrame({"cell": found.ravel(), "home": home, "cluster": np.repeat(own["cluster"].to_numpy(), width), "sketch": np.repeat(sketches(units), width)}).drop_duplicates(["cell", "home", "cluster"])

    sizes = clusters.select("cluster", (F.col("n") == 1).alias("single"))
    placed = members.select("cluster", "vec").mapInPandas(cells, "cell long, home boolean, cluster long, sketch long")
    placed = placed.groupBy("cell", "cluster").agg(F.max("home").alias("home"), F.when(F.count(F.lit(1)) < 3, F.min("sketch")).alias("sketch"))
    placed = placed.join(sizes, "cluster").select("cell", "cluster", "home", F.when(F.col("single"), F.col("sketch")).alias("sketch"))
    a = placed.where("home").select("cell", F.col("cluster").alias("i"), F.col("sketch").alias("si"))
    b = placed.select("cell", F.col("cluster").alias("j"), F.col("sketch").alias("sj"))
    close = F.coalesce(F.bit_count(F.col("si").bitwiseXOR(F.col("sj"))) <= SKETCH_BITS, F.lit(True))
    pairs = a.join(b, "cell").where((F.col("i") != F.col("j")) & close).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    for end in ("i", "j"):
        pairs = pairs.join(clusters.select(F.col("cluster").alias(end), F.col("centre").alias(f"centre_{end}"), F.col("radius").alias(f"radius_{end}"), F.col("n").alias(f"n_{end}")), end)

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame[frame["centre_i"].map(len) == frame["centre_j"].map(len)]
            verdict = np.zeros(len(frame), np.int32)
            lengths = frame["centre_i"].map(len).to_numpy()
            for dims in np.unique(lengths):
                at = np.flatnonzero(lengths == dims)
                x, y = (np.array(frame[c].iloc[at].tolist(), float).reshape(len(at), -1) for c in ("centre_i", "centre_j"))
                spread = (frame["radius_i"] + frame["radius_j"]).to_numpy()[at]
                single = (frame["n_i"] + frame["n_j"]).to_numpy()[at] == 2
                angle = angles(x, y)
                whole = np.where(single, (x * y).sum(1) >= min_cosine, angle + spread <= threshold * (1 - 1e-9))
                verdict[at] = np.where(whole, 2, np.where(~single & (angle - spread <= threshold * (1 + 1e-9)), 1, 0))
            yield frame.assign(verdict=verdict)[["i", "j", "n_i", "n_j", "verdict"]][verdict > 0]

    judged = checkpoint(pairs.mapInPandas(compared, "i long, j long, n_i long, n_j long, verdict int"))
    whole = judged.where("verdict = 2")
    links = whole.select(F.col("i").alias("cluster"), F.col("n_j").alias("more")).union(whole.select("j", "n_i")).groupBy("cluster").agg(F.sum("more").alias("more"))
    unsure = judged.where("verdict = 1")
    edges = whole.select("i", "j")
    counted = None
    if not unsure.isEmpty():
        counted, found = _compare_members(members, clusters, unsure, min_cosine)
        edges = edges.union(found)
    labels = connected_components(edges, "i", "j")
    least = members.groupBy("cluster").agg(F.min("id").alias("least"))
    state = clusters.select("cluster", "n").join(least, "cluster").join(links, "cluster", "left").join(labels.withColumnRenamed("node", "cluster"), "cluster", "left")
    state = checkpoint(state.select("cluster", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "cluster").alias("component"), "least"))
    state = checkpoint(state.join(state.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("cluster", "n_links", "component_id"))
    linked = members.drop("vec").join(state, "cluster")
    if counted is not None:
        linked = linked.join(counted, "row", "left").withColumn("n_links", F.col("n_links") + F.coalesce("unsure_links", F.lit(0)))
    every = linked.select(F.col("id").alias(id_col), "n_links", "component_id").union(alone)
    return every.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _compare_members(members: DataFrame, clusters: DataFrame, unsure: DataFrame, min_cosine: float) -> tuple[DataFrame, DataFrame]:
    """((row, unsure_links), (i, j) pairs with a link): members compared chunk by chunk, about CHUNK at a time."""
    involved = unsure.select(F.col("i").alias("cluster")).union(unsure.select("j")).distinct().join(clusters.select("cluster", "n"), "cluster")
    chunks = members.join(involved, "cluster").withColumn("chunk", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / CHUNK)))
    chunks = checkpoint(chunks.groupBy("cluster", "chunk").agg(F.collect_list(F.struct("row", "vec")).alias("rows")))
    both = unsure.select("i", "j")
    for end in ("i", "j"):
        both = both.join(chunks.select(F.col("cluster").alias(end), F.col("rows").alias(f"rows_{end}")), end)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for pair in frame.itertuples():
                x, y = (np.array([r["vec"] for r in rows]) for rows in (pair.rows_i, pair.rows_j))
                linked = x @ y.T >= min_cosine
                if linked.any():
                    for cluster, other, rows, n in ((pair.i, pair.j, pair.rows_i, linked.sum(1)), (pair.j, pair.i, pair.rows_j, linked.sum(0))):
                        yield pd.DataFrame({"cluster": cluster, "other": other, "row": [r["row"] for r in rows], "n": n})

    found = checkpoint(both.mapInPandas(count, "cluster long, other long, row long, n long"))
    counted = found.groupBy("row").agg(F.sum("n").alias("unsure_links"))
    return counted, found.where("cluster < other").select(F.col("cluster").alias("i"), F.col("other").alias("j")).distinct()

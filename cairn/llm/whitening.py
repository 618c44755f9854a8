"""Whitening of vectors by a covariance that is exact: polarisation of squared centred sums.

Vectors become whole numbers x. The fit list has each different x once, so copies, however
many, weigh once. With n vectors and sums S, the centred entry n*x - S is a whole number.
For every dimension, and for every pair of dimensions the sum of both, the squares of
these numbers are summed exactly: a task splits them into limbs of 21 bits, whose products
are summed in 64 bits, and hands on one total per dimension and pair as digits of 32 bits;
Spark adds the digits of all tasks. As var(a + b) - var(a) - var(b) is twice the covariance,
differences of the totals give every covariance without any rounding. The matrix, divided
by n^3 and rounded once, goes to eigh; its side is the vectors' length, not their number.

Vectors of different lengths are fitted apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import checkpoint, new_path, remove

#: x is floor(SCALE * c) + SHIFT, and floors beyond this stay there.
SCALE, SHIFT, MOST = 64, 1_000_000, 1 << 61
COMPONENTS = 16
LIMB, DIGIT, DIGITS = 21, 32, 12
#: Rows that are squared at once; a limb's products are below 2^42, so a sum of so many stays far below 2^63.
ROWS = 512
#: Bytes of means and components that are sent to all executors; beyond, a join deals them out.
BROADCAST_FITS = 32 << 20

_TOTALS = f"dims int, a int, b int, {', '.join(f'd{i} long' for i in range(DIGITS))}"


def whole(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, dims, x) of the rows whose vector is there, not empty and finite."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.expr("vec is not null and size(vec) > 0 and forall(vec, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    floor = lambda c: F.floor(F.greatest(F.least(c * F.lit(float(scale)), F.lit(float(MOST))), F.lit(-float(MOST)))).cast("long") + F.lit(shift)
    return rows.where(fine).select("id", F.size("vec").alias("dims"), F.transform("vec", floor).alias("x"))


def limbs(values: np.ndarray) -> list[np.ndarray]:
    """The numbers' magnitudes as limbs of 21 bits, the lowest first; values are of 64 bits or Python's."""
    rest, out = np.abs(values), []
    while True:
        out.append((rest & ((1 << LIMB) - 1)).astype(np.int64))
        rest = rest >> LIMB
        if not rest.any():
            return out


def squared_sums(values: np.ndarray) -> list[int]:
    """The exact sum of the squares of each column."""
    parts = limbs(values)
    total = [0] * values.shape[1]
    for i, a in enumerate(parts):
        for j, b in enumerate(parts[: i + 1]):
            sums = np.einsum("rc,rc->c", a, b)
            total = [t + ((int(s) << LIMB * (i + j)) << (i != j)) for t, s in zip(total, sums, strict=True)]
    return total


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, in 64 bits where it and a sum of two of it fit, else in Python's numbers."""
    most = max(n * max(abs(int(x.max())), abs(int(x.min()))), max(map(abs, sums)))
    if most < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def assembled(dims: int, totals: dict[tuple[int, int], int], n: int) -> np.ndarray:
    """The covariance matrix from the squared sums, those of dimension a at (a, a) and of the pair's sum at (a, b)."""
    out = np.empty((dims, dims))
    for (a, b), t in totals.items():
        twice = 2 * t if a == b else t - totals[a, a] - totals[b, b]
        out[a, b] = out[b, a] = twice / (2 * n**3)  # whole numbers: the quotient is rounded once
    return out


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as rows."""
    values, vectors = np.linalg.eigh(covariance)
    return values[::-1][:most], vectors.T[::-1][:most]


def fit(fit_list: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(dims, n, sums, values, vectors, trace) of each length of vector; fit_list: (dims, x), each x once, from a table."""
    spark = fit_list.sparkSession
    sums = fit_list.select("dims", F.posexplode("x").alias("at", "v")).groupBy("dims", "at").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("s"))
    heads: dict[int, tuple[int, list[int]]] = {}
    for row in sums.orderBy("dims", "at").toLocalIterator():  # a row for each dimension of each length
        heads.setdefault(row.dims, (row.n, []))[1].append(int(row.s))
    sent = spark.sparkContext.broadcast(heads)

    def square(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple[int, int, int], int] = {}
        for frame in frames:
            for dims, own in frame.groupby("dims"):
                n, s = sent.value[dims]
                for at in range(0, len(own), ROWS):
                    y = centred(np.array(own["x"].iloc[at : at + ROWS].tolist(), np.int64), n, s)
                    for b, t in enumerate(squared_sums(y)):
                        totals[dims, b, b] = totals.get((dims, b, b), 0) + t
                    for a in range(dims - 1):
                        for b, t in enumerate(squared_sums(y[:, a : a + 1] + y[:, a + 1 :]), a + 1):
                            totals[dims, a, b] = totals.get((dims, a, b), 0) + t
        mask = (1 << DIGIT) - 1
        yield pd.DataFrame([(*key, *(t >> DIGIT * i & mask for i in range(DIGITS))) for key, t in totals.items()], columns=["dims", "a", "b", *(f"d{i}" for i in range(DIGITS))])

    digits = fit_list.mapInPandas(square, _TOTALS).groupBy("dims", "a", "b").agg(*(F.sum(f"d{i}").alias(f"d{i}") for i in range(DIGITS)))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        dims = int(frame["dims"].iloc[0])
        n, s = sent.value[dims]
        totals = {(r.a, r.b): sum(int(getattr(r, f"d{i}")) << DIGIT * i for i in range(DIGITS)) for r in frame.itertuples()}
        covariance = assembled(dims, totals, n)
        values, vectors = components(covariance, most)
        return pd.DataFrame([(dims, n, [str(v) for v in s], values.tolist(), vectors.ravel().tolist(), float(np.trace(covariance)))], columns=["dims", "n", "sums", "values", "vectors", "trace"])

    return digits.groupBy("dims").applyInPandas(solve, "dims int, n long, sums array<string>, values array<double>, vectors array<double>, trace double")


def projected(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """rows with n, trace, values, deviation (sum of the squared n*x - S, the most digits a decimal has where it is more) and whitened, by component.

    A component whose eigenvalue is zero but for rounding has a null in whitened.
    """
    names = [c for c in rows.columns if c != "x"]

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            deviations, whitened = [0] * len(frame), [None] * len(frame)
            for dims, places in frame.groupby("dims").indices.items():
                own = frame.iloc[places]
                n, s, e = int(own["n"].iloc[0]), [int(v) for v in own["sums"].iloc[0]], np.array(own["values"].iloc[0])
                axes = np.array(own["vectors"].iloc[0]).reshape(len(e), dims)
                y = centred(np.array(own["x"].tolist(), np.int64), n, s)
                flat = e > dims * np.finfo(float).eps * max(e[0], 0)
                with np.errstate(all="ignore"):
                    z = (y.astype(float) / n) @ (axes[flat] / np.sqrt(e[flat])[:, None]).T
                for place, d, row in zip(places, squared_sums(y.T), z, strict=True):
                    values = iter(row.tolist())
                    deviations[place] = str(min(d, 10**38 - 1))
                    whitened[place] = [next(values) if kept else None for kept in flat]
            yield frame[[*names, "n", "trace", "values"]].assign(deviation=deviations, whitened=whitened)

    size = fits.agg(F.sum((F.size("vectors") + 4 * F.col("dims")) * 8)).first()[0] or 0
    joined = rows.join(F.broadcast(fits) if size <= BROADCAST_FITS else fits, "dims")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = joined.mapInPandas(project, ", ".join([*(f"{c} {kinds[c]}" for c in names), "n long", "trace double", "values array<double>", "deviation string", "whitened array<double>"]))
    return found.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_errors(white: DataFrame) -> DataFrame:
    """(dims, identity_error): how far the covariance of (dims, whitened) is from the identity; centred by its own mean before it is multiplied."""
    means = white.select("dims", F.posexplode("whitened").alias("at", "v")).groupBy("dims", "at").agg(F.avg("v").alias("mean"))
    means = means.groupBy("dims").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "mean"))), lambda m: m["mean"]).alias("means"))
    moved = white.join(F.broadcast(means), "dims").select("dims", F.zip_with("whitened", "means", lambda v, m: v - m).alias("z"))  # a row for each length of vector

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, tuple[int, np.ndarray]] = {}
        for frame in frames:
            for dims, own in frame.groupby("dims"):
                z = np.array(own["z"].tolist(), float)
                rows, products = totals.get(dims, (0, 0.0))
                totals[dims] = rows + len(z), products + z.T @ z
        yield pd.DataFrame([(dims, a, b, rows, p[a, b]) for dims, (rows, p) in totals.items() for a in range(len(p)) for b in range(a, len(p)) if np.isfinite(p[a, b])], columns=["dims", "a", "b", "rows", "total"])

    sums = moved.mapInPandas(multiply, "dims int, a int, b int, rows long, total double")
    covariance = sums.groupBy("dims", "a", "b").agg((F.sum("total") / F.sum("rows")).alias("c"))
    return covariance.groupBy("dims").agg(F.max(F.abs(F.col("c") - F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0))).alias("identity_error"))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each vector and component, up to ``most`` or the vectors' length.

    Vectors that are null, empty or hold null or non-finite entries get no row. Equal vectors weigh once in the fit, whatever
    their number; every row is whitened, repeated ones and those with a null id as well. Vectors of one length are fitted
    together and apart from those of another. Where all fitted vectors are the same or lie in fewer dimensions, whitened is
    null for the components without variance, which the identity error leaves out; explained is null where nothing varies. A
    floor beyond 2^61 stays there. Equal eigenvalues keep the solver's order. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = whole(vectors, id_col, vec_col, scale, shift)
    path = new_path(spark)
    fit_list = checkpoint(rows.select("dims", "x").distinct(), path)
    fits = checkpoint(fit(fit_list, most))
    errors = checkpoint(identity_errors(projected(fit_list, fits).select("dims", "whitened")))
    remove(spark, path)
    # a row for each length of vector, as fits
    white = projected(rows, fits).join(F.broadcast(errors), "dims", "left")
    return white.select("id", "n", "deviation", "trace", "values", "identity_error", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("id").alias(id_col),
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        "whitened",
        F.when(F.col("trace") > 0, F.greatest(F.col("values")[F.col("at")], F.lit(0.0)) / F.col("trace")).alias("explained"),
        "identity_error",
    )

"""Recursions along ordered rows as associative scans, and the motion noise that is estimated by one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.positions import positions
from cairn.session import checkpoint

#: Rows that are folded at once; a run of n rows takes log n to this base levels.
BLOCK = 256


def affine_scan(rows: DataFrame, by: list[str], at: str, block: int = BLOCK) -> DataFrame:
    """(by, at, state): state = d * the state before + v along ``at``, which counts from 0 in each group, from a state of zeros.

    rows: (by, at, d double, v array<double>). Two steps after each other are again a factor and a vector, so blocks of
    rows are folded on their own, the blocks' results are scanned in the same way, and each row adds what
    came before its block: no task ever holds more than a block, and a group is as long as it likes.
    """
    rows = rows.select(*by, F.col(at).alias("_at"), "d", "v")
    step = F.struct("_at", "d", "v")
    empty = F.array().cast("array<struct<_at:bigint,d:double,v:array<double>>>")

    def fold(done, x):
        last = F.get(done, F.size(done) - 1)
        now = F.struct(
            x["_at"].cast("bigint").alias("_at"),
            (x["d"] * F.coalesce(last["d"], F.lit(1.0))).alias("d"),
            F.when(last.isNull(), x["v"]).otherwise(F.zip_with(x["v"], last["v"], lambda new, old: new + x["d"] * old)).alias("v"),
        )
        return F.concat(done, F.array(now))

    blocks = rows.groupBy(*by, F.floor(F.col("_at") / block).alias("_block")).agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    blocks = checkpoint(blocks.select(*by, "_block", F.aggregate("_steps", empty, fold).alias("_steps")))
    ends = blocks.select(*by, F.col("_block").alias("at"), F.element_at("_steps", -1).alias("_e")).select(*by, "at", F.col("_e.d").alias("d"), F.col("_e.v").alias("v"))
    inner = blocks.select(*by, "_block", F.explode("_steps").alias("_x"))
    if (blocks.agg(F.max("_block")).first()[0] or 0) > 0:
        before = affine_scan(ends, by, "at", block).select(*by, (F.col("at") + 1).alias("_block"), F.col("state").alias("_carry"))
        inner = inner.join(before, [*by, "_block"], "left")
    else:
        inner = inner.withColumn("_carry", F.lit(None).cast("array<double>"))
    state = F.when(F.col("_carry").isNull(), F.col("_x.v")).otherwise(F.zip_with("_x.v", "_carry", lambda own, old: own + F.col("_x.d") * old))
    return inner.select(*by, F.col("_x._at").alias(at), state.alias("state"))


def motion_noise(errors: DataFrame, by: list[str], order: str, rate: float = 1 / 60, size: int = 6) -> DataFrame:
    """(by, order, weight0, weight1, noise): after each row the covariance of a motion's change, size by size and row-major.

    errors: (by, order, error array, steps). Rows of one step add error error^T to a covariance, and, if the row before was of one step as
    well, error (error before)^T to a second, both exponentially weighted by ``rate``; other rows add nothing and leave both. The
    noise is the first over its weight plus 3/4 of the second and its transpose over its own, moved to the nearest matrix without
    negative eigenvalues; zeros before anything was added. Rows with a null key, order, error or entry, or an error of another size, are left out.
    """
    rows = errors.select(*by, order, F.transform("error", lambda x: x.cast("double")).alias("error"), "steps").where((F.size("error") == size) & F.expr("forall(error, x -> x is not null)")).dropna()
    rows = positions(rows, by, [order, "steps", "error"])
    ahead = rows.select(*by, (F.col("position") + 1).alias("position"), F.when(F.col("steps") == 1, F.col("error")).alias("_before"))
    rows = rows.join(ahead, [*by, "position"], "left")
    one, two = F.col("steps") == 1, (F.col("steps") == 1) & F.col("_before").isNotNull()
    outer = lambda a, b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: rate * x * y)))
    zeros = F.array_repeat(F.lit(0.0), size * size)
    steps = checkpoint(
        rows.select(
            *by,
            order,
            "position",
            F.when(one, 1 - rate).otherwise(1.0).alias("d0"),
            F.concat(F.when(one, outer("error", "error")).otherwise(zeros), F.array(F.when(one, rate).otherwise(0.0))).alias("v0"),
            F.when(two, 1 - rate).otherwise(1.0).alias("d1"),
            F.concat(F.when(two, outer("error", "_before")).otherwise(zeros), F.array(F.when(two, rate).otherwise(0.0))).alias("v1"),
        )
    )
    lags = [affine_scan(steps.select(*by, "position", F.col(f"d{i}").alias("d"), F.col(f"v{i}").alias("v")), by, "position").withColumnRenamed("state", f"lag{i}") for i in (0, 1)]
    both = steps.select(*by, order, "position").join(lags[0], [*by, "position"]).join(lags[1], [*by, "position"]).drop("position")
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            a, b = (np.array(frame[f"lag{i}"].tolist(), float).reshape(len(frame), -1) for i in (0, 1))
            first, second = (x[:, :-1].reshape(-1, size, size) for x in (a, b))
            with np.errstate(all="ignore"):
                q = np.where(a[:, -1:, None] > 0, first / a[:, -1:, None], 0) + np.where(b[:, -1:, None] > 0, 0.75 / b[:, -1:, None] * (second + np.swapaxes(second, 1, 2)), 0)
            values, vectors = np.linalg.eigh(q)
            noise = (vectors * np.maximum(values, 0)[:, None]) @ np.swapaxes(vectors, 1, 2)
            yield frame[[*by, order]].assign(weight0=a[:, -1], weight1=b[:, -1], noise=list(noise.reshape(len(frame), -1)))

    return both.mapInPandas(judge, "".join(f"`{c}` {kinds[c]}, " for c in [*by, order]) + "weight0 double, weight1 double, noise array<double>")

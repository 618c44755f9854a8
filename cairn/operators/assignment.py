"""One-to-one assignment by rounds of proposals, and slot layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import checkpoint


def propose_accept(candidates: DataFrame, by: list[str], rounds: int = 4) -> DataFrame:
    """(by, a_id, b_id, cost, round) of candidates (by, a_id, b_id, cost).

    In each round every free a proposes to its cheapest free b (ties to the lower b) and
    every b accepts its cheapest proposal (ties to the lower a). Both steps are partial
    aggregates; a round ends the loop early if it matches nothing.
    """
    free, found = candidates.select(*by, "a_id", "b_id", "cost"), None
    for n in range(rounds):
        proposed = free.groupBy(*by, "a_id").agg(F.min(F.struct("cost", "b_id")).alias("m")).select(*by, "a_id", "m.cost", "m.b_id")
        accepted = proposed.groupBy(*by, "b_id").agg(F.min(F.struct("cost", "a_id")).alias("m")).select(*by, "m.a_id", "b_id", "m.cost", F.lit(n).alias("round"))
        accepted = checkpoint(accepted)
        if accepted.isEmpty():
            break
        found = accepted if found is None else found.unionByName(accepted)
        free = free.join(accepted.select(*by, "a_id"), [*by, "a_id"], "left_anti").join(accepted.select(*by, "b_id"), [*by, "b_id"], "left_anti")
    return found if found is not None else candidates.select(*by, "a_id", "b_id", "cost", F.lit(0).alias("round")).limit(0)


def layout(rows: DataFrame, by: list[str], priority: Column, order: list[Column], cap: int) -> DataFrame:
    """rows with slot: positions by priority, then order, in each group; rows beyond the cap get none."""
    slot = F.row_number().over(Window.partitionBy(*by).orderBy(priority, *order)) - 1
    return rows.withColumn("slot", slot).where(F.col("slot") < cap)

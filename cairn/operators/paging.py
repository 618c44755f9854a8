"""Keyset pages: a filter beyond the last key, then the first rows in key order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LIMIT = 1000


def page(df: DataFrame, keys: list[str], after: tuple | None = None, limit: int = 100) -> DataFrame:
    """Up to limit + 1 rows in key order after the key; the extra row says that there is more.

    The composite key is compared column by column, so the first column's bound reaches the scan.
    """
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be from 1 to {MAX_LIMIT}")
    if after is not None:
        beyond = F.lit(False)
        for i in reversed(range(len(keys))):
            beyond = (F.col(keys[i]) > after[i]) | ((F.col(keys[i]) == after[i]) & beyond)
        df = df.where((F.col(keys[0]) >= after[0]) & beyond)
    return df.orderBy(*keys).limit(limit + 1)


def ordinal(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The row at 0-based position n in key order."""
    return df.orderBy(*keys).offset(n).limit(1)


def every_nth(df: DataFrame, key: str, step: int, most: int | None = None) -> DataFrame:
    """Rows at positions 0, step, 2 step, ... in key order, ``most`` of them; positions by dense range counting."""
    from cairn.operators.tracks import dense_ids

    numbered = dense_ids(df, key, "position").where(F.pmod("position", F.lit(step)) == 0)
    return numbered if most is None else numbered.where(F.col("position") < step * most)

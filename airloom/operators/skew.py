"""Joins in which one key may hold a large part of the rows.

Adaptive execution splits a skewed join only where both sides come straight from a shuffle. A
side that was aggregated by the join key does not: it is partitioned already, and Spark then
leaves all rows of a hot key in one task. A salt next to the key spreads such rows, and as
neither side is partitioned by key and salt before, the adaptive split applies on top.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = "_salt"
SALTS = 8


def spread_out(df: DataFrame, by: Sequence[str], salts: int = SALTS) -> DataFrame:
    """The large side: every row gets one salt, always the same for the same ``by`` values."""
    return df.withColumn(SALT, F.pmod(F.xxhash64(*by), F.lit(salts)))


def on_every_salt(df: DataFrame, salts: int = SALTS) -> DataFrame:
    """The small side, with few rows per key: a copy of every row for each salt.

    Spark's size estimate does not count the copies, so it would broadcast a table that is too large
    for the driver. The hint keeps the join a shuffled one.
    """
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))
    return df.withColumn(SALT, copies).hint("merge")


def salted_join(
    large: DataFrame,
    small: DataFrame,
    on: str,
    by: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """``large.join(small, on, how)`` with the rows of each key spread by the ``by`` columns.

    For inner, left, semi and anti joins; ``by`` should vary within a key.
    """
    left, right = spread_out(large, by, salts), on_every_salt(small, salts)
    return left.join(right, [on, SALT], how).drop(SALT)

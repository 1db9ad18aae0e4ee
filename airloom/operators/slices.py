"""Ordered windows over groups of any size.

A window sends each of its groups to one task. A creator or queue that holds a third of all
rows would then hold up the whole job, so the operators that need row order work in two steps:

1. every group is cut into *slices* along its order, and the window runs inside
   ``(keys, slice)``;
2. each slice is summed up in one row, a window over these few rows brings along what the
   earlier or later slices contribute, and that row is joined back to its slice.

Slices are stretches of time or keys of a given width, or, by :func:`in_slices`, ranges of about
equally many rows. The latter hold for ties, bursts and sparse keys.

Step 2 sees one row per key and slice, however many rows the slice has. Its aggregation is
combined before the shuffle, and the join is on the columns that step 1 is partitioned by.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from airloom.session import stored

SLICE = "_slice"


def in_slices(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """``rows`` cut into ranges of about equally many rows along keys and order.

    The slices are the partitions of Spark's range partitioning, which samples the rows for its
    bounds: as many as ``spark.sql.shuffle.partitions``, whatever the values are, and a group has
    no more of them than that. Rows that agree in keys and order share a slice. The result is
    written to the shared folder by a job of its own, as the bounds may differ from one
    evaluation to the next; later steps read that table.
    """
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(count, *keys, *order)
    return stored(cut.withColumn(SLICE, F.spark_partition_id()), "slices")


def within_slice(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    """The window of step 1."""
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def earlier_slices(keys: Sequence[str]) -> WindowSpec:
    """All slices of a group before the current one."""
    ordered = Window.partitionBy(*keys).orderBy(SLICE)
    return ordered.rowsBetween(Window.unboundedPreceding, -1)


def slice_order(keys: Sequence[str]) -> WindowSpec:
    """The slices of a group in order, for ``lag`` and ``lead`` between them."""
    return Window.partitionBy(*keys).orderBy(SLICE)


def slice_totals(
    rows: DataFrame, keys: Sequence[str], totals: Mapping[str, Column]
) -> DataFrame:
    """One row per key and slice. Rows must have the slice number in ``_slice``."""
    return rows.groupBy(*keys, SLICE).agg(
        *(expression.alias(name) for name, expression in totals.items())
    )


def join_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add what was brought along to the rows of each slice.

    Call it after the windows of step 1: the rows are then partitioned and sorted as the join
    needs them. There must be no NULL in keys or slice.
    """
    return rows.join(carry, [*keys, SLICE], "left")


def require(df: DataFrame, *names: str) -> DataFrame:
    """Rows that have a value in all these columns."""
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(name).isNotNull()
    return df.where(condition)

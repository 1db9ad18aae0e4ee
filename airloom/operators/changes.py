"""Two states of a table compared as multisets of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGES = ("added", "kept", "removed")


def state_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """The change list from one state of a catalogue to the next: ``(*columns, change, n)``.

    Rows count as often as they stand: of a row that was there 3 times and is there twice, 2 are
    ``kept`` and 1 is ``removed``. ``added`` is ``after EXCEPT ALL before``, ``removed`` the other way round, and
    ``kept`` is ``INTERSECT ALL``, each with a count instead of copies. NULL is a value like any other. Both
    states have the same columns in any order; none may be a map, which can't be compared, or be called ``change`` or ``n``.

    One pass and one shuffle for all three lists; equal rows are counted in the tasks first, so
    a row with very many copies is no burden.
    """
    if set(before.columns) != set(after.columns) or len(before.columns) != len(after.columns):
        raise ValueError("both states need the same columns")
    if {"change", "n"} & set(before.columns):
        raise ValueError("change and n are columns of the result")
    columns = before.columns
    kept = [F.col(f"`{name}`") for name in columns]
    whole = F.struct(*kept).alias("_row")
    both = before.select(whole, F.lit(1).alias("_before"), F.lit(0).alias("_after")).unionByName(
        after.select(whole, F.lit(0).alias("_before"), F.lit(1).alias("_after"))
    )
    counted = both.groupBy("_row").agg(F.sum("_before").alias("b"), F.sum("_after").alias("a"))
    lists = F.array(
        F.struct(F.lit("added").alias("_change"), (F.col("a") - F.col("b")).alias("_n")),
        F.struct(F.lit("kept").alias("_change"), F.least("a", "b").alias("_n")),
        F.struct(F.lit("removed").alias("_change"), (F.col("b") - F.col("a")).alias("_n")),
    )
    changes = counted.select("_row", F.inline(lists)).where(F.col("_n") > 0)
    return changes.select(
        *(F.col(f"_row.`{name}`").alias(name) for name in columns),
        F.col("_change").alias("change"),
        F.col("_n").alias("n"),
    )

"""How many items beat an item on two figures at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airloom.operators.slices import (
    SLICE,
    earlier_slices,
    in_slices,
    join_carry,
    require,
    slice_totals,
    within_slice,
)
from airloom.session import stored

#: Rows to a stripe, and so the most that a task orders at once; more for beyond some billion rows.
STRIPE = 1 << 16


def dominance_counts(items: DataFrame, less: str, more: str, stripe: int = STRIPE) -> DataFrame:
    """``items`` with ``beaten_by``: how many others are below in ``less`` and above in ``more``.

    Say, programmes that are cheaper and larger. Both strictly, so equal figures beat nobody; rows
    with NULL in either are kept with NULL. Repeated rows are rows of their own. NaN is above all numbers.

    Counted without pairs. Rows are numbered along both figures, by range slices of about equally many rows
    (jobs that run at once), and cut in stripes of ``stripe`` rows along either number. A row is
    beaten by those in earlier stripes of both kinds, which follows from the prefix sums of a grid
    of stripes; by those in its stripe of the one kind that are in an earlier one of the other; and by
    those in its own stripe of the other kind. The latter two are counted inside a stripe, in as many
    steps as its rows have bits. Ties are numbered so that they never count.
    """
    if stripe < 1:
        raise ValueError("a stripe has a row at least")
    columns = [name for name in items.columns if name != "beaten_by"]
    spread = F.xxhash64(F.monotonically_increasing_id())
    rows = items.select(
        F.struct(*(F.col(f"`{name}`") for name in columns)).alias("_row"),
        F.col(less).alias("_less"),
        F.col(more).alias("_more"),
        F.monotonically_increasing_id().alias("_key"),
        spread.alias("_spread"),
    )
    rows = stored(rows, "dominance-rows")
    known = require(rows, "_less", "_more").drop("_row")
    # Rows equal in one figure go the one way along it and the other way along the other.
    along = _numbered(known, ["_less", "_more", "_spread"], [True, True, True], "_x")
    along = stored(_numbered(along, ["_more", "_less", "_spread"], [False, False, False], "_y"), "dominance-numbers")
    count = along.count()
    stripe = max(stripe, int(np.ceil(np.sqrt(count))))
    placed = along.select(
        "_key", "_x", "_y", F.floor(F.col("_x") / stripe).alias("_a"), F.floor(F.col("_y") / stripe).alias("_b")
    )
    stripes = -(-count // stripe)
    grid = _grid(placed, stripes)
    in_b = _counted(placed.select("_key", F.col("_b").alias("_stripe"), F.col("_a").alias("_u"), F.col("_y").alias("_v")))
    in_a = _counted(placed.select("_key", F.col("_a").alias("_stripe"), F.col("_x").alias("_u"), F.col("_y").alias("_v")))
    parts = in_a.unionByName(in_b).groupBy("_key").agg(F.sum("_n").alias("_near"))
    total = (
        placed.select("_key", "_a", "_b")
        .join(grid, ["_a", "_b"])
        .join(parts, "_key")
        .select("_key", (F.col("_before") + F.col("_near")).alias("_beaten_by"))
    )
    found = rows.select("_key", "_row").join(total, "_key", "left")
    kept = [F.col(f"_row.`{name}`").alias(name) for name in columns]
    return found.select(*kept, F.col("_beaten_by").alias("beaten_by"))


def _numbered(rows: DataFrame, order: list[str], up: list[bool], name: str) -> DataFrame:
    """Rows numbered from 0 in this order, by range slices."""
    # One key for all rows: the slices are what spreads them.
    keyed = rows.withColumn("_all", F.lit(0))
    columns = [F.col(c).asc() if rising else F.col(c).desc() for c, rising in zip(order, up, strict=True)]
    cut = in_slices(keyed, ["_all"], columns)
    carry = slice_totals(cut, ["_all"], {"_n": F.count(F.lit(1))}).select(
        "_all", SLICE, F.sum("_n").over(earlier_slices(["_all"])).alias("_before")
    )
    place = F.row_number().over(within_slice(["_all"], columns))
    numbered = join_carry(cut.withColumn("_place", place), carry, ["_all"])
    number = F.coalesce("_before", F.lit(0)) + F.col("_place") - 1
    return numbered.withColumn(name, number).drop("_all", SLICE, "_place", "_before")


def _grid(placed: DataFrame, stripes: int) -> DataFrame:
    """``(_a, _b, _before)``: the rows in earlier stripes of both kinds.

    A row per cell of the grid, at most about as many as there are rows; windows see a line of it.
    """
    cells = placed.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    lines = placed.sparkSession.range(stripes).withColumnRenamed("id", "_a")
    every = lines.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(max(stripes, 1) - 1)).cast("array<bigint>")))
    dense = every.join(cells, ["_a", "_b"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    earlier = Window.unboundedPreceding, -1
    across = dense.withColumn("_line", F.sum("_n").over(Window.partitionBy("_a").orderBy("_b").rowsBetween(*earlier)))
    down = F.sum("_line").over(Window.partitionBy("_b").orderBy("_a").rowsBetween(*earlier))
    return across.select("_a", "_b", F.coalesce(down, F.lit(0)).alias("_before"))


def _counted(rows: DataFrame) -> DataFrame:
    """``(_key, _n)``: the rows of the stripe that are below in both ``_u`` and ``_v``."""

    def count(stripe: pa.Table) -> pa.Table:
        u, v = (stripe.column(name).to_numpy() for name in ("_u", "_v"))
        return pa.table({"_key": stripe.column("_key"), "_n": pa.array(below_both(u, v), pa.int64())})

    return rows.groupBy("_stripe").applyInArrow(count, "_key bigint, _n bigint")


def below_both(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each place, how many others are below in both; the values of ``v`` are all different.

    The rank of ``v`` is looked at bit by bit: of two ranks that agree above a bit, the one without it
    is lower. So per bit, those without are counted along ``u`` among the ranks that agree above.
    """
    n = len(u)
    found = np.zeros(n, dtype=np.int64)
    rank = np.empty(n, dtype=np.int64)
    rank[np.argsort(v)] = np.arange(n)
    along = np.argsort(u, kind="stable")
    for bit in range(max(n - 1, 0).bit_length()):
        order = along[np.argsort(rank[along] >> (bit + 1), kind="stable")]
        group, has = rank[order] >> (bit + 1), (rank[order] >> bit) & 1
        lower = np.cumsum(1 - has)
        # Not those of equal u: what was counted before the first of them.
        same = np.r_[False, (group[1:] == group[:-1]) & (u[order][1:] == u[order][:-1])] if n else has == 1
        first = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        before = np.r_[0, lower[:-1]][first]
        begins = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], np.arange(n), 0))
        found[order] += has * (before - np.r_[0, lower[:-1]][begins])
    return found

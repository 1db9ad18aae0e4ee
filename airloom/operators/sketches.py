"""Distinct counts from stored sketches, for any range and combination of groups, without the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH = "sketch"
#: Three standard errors.
ERRORS = 3.0


def distinct_sketches(
    events: DataFrame, by: Sequence[str], value: str, size_log2: int = 12
) -> DataFrame:
    """``(*by, sketch)``: a Theta sketch of the distinct values of each group, say day and kind.

    To be stored and merged by :func:`distinct_counts` and :func:`distinct_shared`. A sketch keeps
    about ``2**size_log2`` hashes however many rows there are, and is exact below that. It is built
    in the tasks before the shuffle, so a hot group is no burden. NULL values do not count; a group of
    NULLs only has an empty sketch.
    """
    return events.groupBy(*by).agg(F.theta_sketch_agg(value, size_log2).alias(SKETCH))


def distinct_counts(sketches: DataFrame, by: Sequence[str], size_log2: int = 12) -> DataFrame:
    """Distinct values in the union of the sketches of each group: ``(*by, estimate, low, high)``.

    ``low`` and ``high`` are three standard errors away, or ``estimate`` itself while it is exact.
    ``size_log2`` must be that of the sketches. Which days and kinds are in a group is up to the caller: filter
    ``sketches``, and leave out of ``by`` what is to be united.
    """
    united = sketches.groupBy(*by).agg(F.theta_union_agg(SKETCH, size_log2).alias(SKETCH))
    estimate = F.theta_sketch_estimate(SKETCH)
    return united.select(*by, estimate.alias("estimate"), *_bounds(estimate, estimate, size_log2))


def distinct_shared(
    sketches: DataFrame, by: Sequence[str], over: str, wanted: Sequence[object], size_log2: int = 12
) -> DataFrame:
    """Values that stand in every one of the ``wanted`` groups of ``over``: ``(*by, estimate, low, high)``.

    Sketches are united within each group of ``by`` and ``over`` first and then intersected. The error of
    an intersection follows the size of the union, not its own. Where a wanted group is missing
    nothing is shared.
    """
    if not wanted:
        raise ValueError("name the groups to intersect")
    parts = (
        sketches.where(F.col(over).isin(*wanted))
        .groupBy(*by, over)
        .agg(F.theta_union_agg(SKETCH, size_log2).alias(SKETCH))
    )
    found = parts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_groups"),
        F.theta_intersection_agg(SKETCH).alias("_shared"),
        F.theta_union_agg(SKETCH, size_log2).alias("_all"),
    )
    whole = F.col("_groups") == len(set(wanted))
    shared = F.when(whole, F.theta_sketch_estimate("_shared")).otherwise(F.lit(0).cast("bigint"))
    return found.select(
        *by, shared.alias("estimate"), *_bounds(shared, F.theta_sketch_estimate("_all"), size_log2)
    )


def _bounds(estimate: Column, size: Column, size_log2: int) -> list[Column]:
    kept = 1 << size_log2
    # Up to the size of a sketch all hashes are kept, and the count is exact.
    error = F.when(size < kept, F.lit(0.0)).otherwise(size * F.lit(ERRORS / math.sqrt(kept - 1)))
    return [
        F.greatest(estimate - error, F.lit(0.0)).alias("low"),
        (estimate + error).alias("high"),
    ]

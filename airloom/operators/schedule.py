"""Weekly schedules and time intervals. All intervals are half-open: start <= t < end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.functions.timing import week_second
from airloom.operators.slices import (
    SLICE,
    earlier_slices,
    in_slices,
    join_carry,
    require,
    slice_totals,
)
from airloom.operators.skew import SALT, on_every_salt, spread_out

MINUTES_PER_DAY = 1440
MINUTES_PER_WEEK = 7 * MINUTES_PER_DAY


def merge_intervals(
    df: DataFrame,
    key: str | Sequence[str],
    start: str,
    end: str,
    slice_width: float | None = None,
) -> DataFrame:
    """Union of overlapping or touching intervals: ``(*key, start, end)``.

    Empty and reversed intervals cover nothing and are left out. Intervals with the same start
    are combined before the shuffle.

    The line of one key is shared out over many tasks in slices of about equally many distinct
    starts, by a job that runs at once (see :func:`in_slices`). With ``slice_width``, in units of
    ``start``, the slices have that width instead, without that job.
    """
    keys = [key] if isinstance(key, str) else list(key)
    distinct = _distinct_starts(df, keys, start, end)
    if slice_width is None:
        sliced = in_slices(distinct, keys, ["_start"])
    else:
        sliced = distinct.withColumn(SLICE, F.floor(F.col("_start") / F.lit(slice_width)))
    # Merging inside the slices first leaves a few pieces of each; then the pieces that an
    # earlier slice reaches into are joined up.
    pieces = _across_slices(_islands(sliced, [*keys, SLICE]), keys)
    return pieces.select(*keys, F.col("_start").alias(start), F.col("_end").alias(end))


def _distinct_starts(
    df: DataFrame, keys: Sequence[str], start: str, end: str
) -> DataFrame:
    return (
        require(df, *keys)
        .where(F.col(start) < F.col(end))
        .groupBy(*keys, F.col(start).alias("_start"))
        .agg(F.max(end).alias("_end"))
    )


def _islands(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gaps and islands: a row opens an island if it starts after all before it have ended."""
    ordered = Window.partitionBy(*keys).orderBy("_start")
    before = F.max("_end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("_start") > before), F.col("_start"))
    return (
        df.withColumn("_opens", opens)
        .withColumn("_island", F.max("_opens").over(ordered))
        .groupBy(*keys, "_island")
        .agg(F.max("_end").alias("_end"))
        .withColumnRenamed("_island", "_start")
    )


def _across_slices(islands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join up the islands of neighbouring slices.

    The islands of a slice that start within the reach of earlier slices come first in it, and
    all continue the island that was opened last before the slice.
    """
    earlier = earlier_slices(keys)

    def opens(start: str) -> Column:
        return F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))

    totals = {"_last": F.max("_start"), "_until": F.max("_end")}
    carry = (
        slice_totals(islands, keys, totals)
        .withColumn("_reach", F.max("_until").over(earlier))
        .withColumn("_head", F.max(F.when(opens("_last"), F.col("_last"))).over(earlier))
        .drop("_last", "_until")
    )
    head = F.when(opens("_start"), F.col("_start")).otherwise(F.col("_head"))
    return (
        join_carry(islands, carry, keys)
        .groupBy(*keys, head.alias("_island"))
        .agg(F.max("_end").alias("_end"))
        .withColumnRenamed("_island", "_start")
    )


def weekly_intervals(
    slots: DataFrame,
    key: str,
    dow: str = "dow",
    start_h: str = "start_h",
    end_h: str = "end_h",
    enabled: str = "enabled",
) -> DataFrame:
    """Enabled weekly slots as disjoint intervals of whole minutes: ``(key, start_m, end_m)``.

    Minutes count from Monday 00:00. A slot that ends at or before its start runs past
    midnight, and what runs past Sunday continues on Monday. Slots of one key that overlap or
    touch are merged; a key has 10,080 distinct starts at most.
    """
    begin = (F.col(dow) - 1) * MINUTES_PER_DAY + F.round(F.col(start_h) * 60).cast("int")
    length = F.round(F.col(end_h) * 60).cast("int") - F.round(F.col(start_h) * 60).cast("int")
    length = F.when(length <= 0, length + MINUTES_PER_DAY).otherwise(length)
    minutes = slots.where(F.col(enabled)).select(
        key, begin.alias("_from"), (begin + length).alias("_to")
    )
    parts = F.array(
        F.struct(
            F.col("_from").alias("start_m"),
            F.least(F.col("_to"), F.lit(MINUTES_PER_WEEK)).alias("end_m"),
        ),
        F.struct(F.lit(0).alias("start_m"), (F.col("_to") - MINUTES_PER_WEEK).alias("end_m")),
    )
    # A key has at most as many distinct starts as the week has minutes: one task can order them.
    starts = _distinct_starts(minutes.select(key, F.inline(parts)), [key], "start_m", "end_m")
    return _islands(starts, [key]).select(
        key, F.col("_start").alias("start_m"), F.col("_end").alias("end_m")
    )


def events_in_schedule(events: DataFrame, slots: DataFrame, key: str, ts: str) -> DataFrame:
    """Every event, with ``in_schedule``: whether it falls into an enabled slot of its key.

    Slots are merged first, so an event meets one interval at most and is never repeated. The
    join is on key and salt, with the minutes as residual.
    """
    intervals = on_every_salt(weekly_intervals(slots, key))
    moment = week_second(F.col(ts))
    inside = (moment >= F.col("i.start_m") * 60) & (moment < F.col("i.end_m") * 60)
    same = (F.col(f"e.{key}") == F.col(f"i.{key}")) & (F.col(f"e.{SALT}") == F.col(f"i.{SALT}"))
    return (
        spread_out(events, [ts])
        .alias("e")
        .join(intervals.alias("i"), same & inside, "left")
        .select(
            *(F.col(f"e.{name}") for name in events.columns),
            F.col("i.start_m").isNotNull().alias("in_schedule"),
        )
    )


def schedule_summary(
    bloggers: DataFrame, slots: DataFrame, key: str = "blogger_id", dow: str = "dow"
) -> DataFrame:
    """Per creator the enabled days, the weekly hours and whether anything is configured.

    Overlapping slots count once. Creators without enabled slots are kept with zeros.
    """
    days = slots.where(F.col("enabled")).groupBy(key).agg(F.count_distinct(dow).alias("days"))
    hours = (
        weekly_intervals(slots, key)
        .groupBy(key)
        .agg((F.sum(F.col("end_m") - F.col("start_m")) / 60).alias("weekly_hours"))
    )
    return bloggers.join(days.join(hours, key), key, "left").withColumns(
        {
            "days": F.coalesce("days", F.lit(0)),
            "weekly_hours": F.coalesce("weekly_hours", F.lit(0.0)),
            "configured": F.col("days").isNotNull(),
        }
    )


def timeline_overlap(
    a: DataFrame,
    b: DataFrame,
    key: str | None,
    start: str = "start_s",
    end: str = "end_s",
    bucket: float | None = None,
    id: str = "id",
) -> DataFrame:
    """Overlapping pairs of two sides: ``(key, id_a, id_b, overlap_start, overlap_end, overlap)``.

    Two intervals overlap if one of them starts inside the other. The time line is cut into buckets:
    an interval lies in those it touches, and a start in a single one, so a start is compared with the
    intervals of its bucket (and key, if there is one), and a pair is found once. Empty intervals overlap
    nothing.

    Without ``bucket``, the bucket width follows the lengths: each interval belongs to the level
    of the power of 4 just above its length and is cut into buckets of an eighth of that; starts visit
    all levels that the other side has. Few starts are then compared in vain, and long and short
    intervals may be mixed at will. The levels in use cost a pass over each side, and the pairs
    another one. With ``bucket``, all buckets have this width, which is cheaper if all intervals
    are about that long.
    """
    left, right = (_interval_side(df, mark, key, start, end, id) for df, mark in ((a, "a"), (b, "b")))
    if bucket is not None:
        width = F.lit(float(bucket))
        left, right = (side.withColumn("_others", F.array(F.lit(0))) for side in (left, right))
        left, right = left.withColumn("_level_a", F.lit(0)), right.withColumn("_level_b", F.lit(0))
    else:
        width = F.pow(F.lit(4.0), F.col("_level")) / 8
        of_a, of_b = (
            side.agg(F.collect_set(level)).scalar()
            for side, level in ((left, "_level_a"), (right, "_level_b"))
        )
        left, right = left.withColumn("_others", of_b), right.withColumn("_others", of_a)
    # Part 0: a starts inside b, or with it. Part 1: b starts inside a, after a does.
    on = [*([] if key is None else [key]), "_level", "_part", "_bucket"]
    met = (
        _placed(left, "a", 0, width)
        .join(_placed(right, "b", 1, width).hint("merge"), on)
        .where((F.col("_part") == 0) == (F.col("_start_a") >= F.col("_start_b")))
        .where((F.col("_start_a") < F.col("_end_b")) & (F.col("_start_b") < F.col("_end_a")))
        .withColumn("_begin", F.greatest("_start_a", "_start_b"))
        .withColumn("_finish", F.least("_end_a", "_end_b"))
    )
    return met.select(
        *([] if key is None else [key]),
        "id_a",
        "id_b",
        F.col("_begin").alias("overlap_start"),
        F.col("_finish").alias("overlap_end"),
        (F.col("_finish") - F.col("_begin")).alias("overlap"),
    )


def _placed(side: DataFrame, mark: str, part: int, width: Column) -> DataFrame:
    """A row for each bucket: of the start in ``part``, on all ``_others`` levels, and of the interval in the other."""
    own = F.col(f"_level_{mark}")
    places = F.concat(
        F.transform("_others", lambda level: F.struct(level.alias("_level"), F.lit(part).alias("_part"))),
        F.array(F.struct(own.alias("_level"), F.lit(1 - part).alias("_part"))),
    )
    first = F.floor(F.col(f"_start_{mark}") / width)
    last = F.ceil(F.col(f"_end_{mark}") / width) - 1  # the end itself is outside
    buckets = F.when(F.col("_part") == part, F.array(first)).otherwise(F.sequence(first, last))
    return (
        side.select("*", F.inline(places))
        .withColumn("_bucket", F.explode(buckets))
        .drop(f"_level_{mark}", "_others")
    )


def _interval_side(
    df: DataFrame, mark: str, key: str | None, start: str, end: str, id: str
) -> DataFrame:
    return df.where(F.col(start) < F.col(end)).select(
        *([] if key is None else [key]),
        F.col(id).alias(f"id_{mark}"),
        F.col(start).alias(f"_start_{mark}"),
        F.col(end).alias(f"_end_{mark}"),
        F.ceil(F.log2(F.col(end) - F.col(start)) / 2).cast("int").alias(f"_level_{mark}"),
    )

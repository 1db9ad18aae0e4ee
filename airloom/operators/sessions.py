"""Sessions: stretches of events without a long pause."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.functions.timing import seconds_between, time_type
from airloom.operators.slices import (
    SLICE,
    in_slices,
    join_carry,
    require,
    slice_order,
    slice_totals,
    within_slice,
)


def session_starts(events: DataFrame, key: str, ts: str, gap_s: float) -> DataFrame:
    """``events`` with ``session_start``, the time of the first event of their session.

    A session of a key goes on while the next event comes at most ``gap_s`` seconds after the last.
    Rows without a key or time are left out; a column ``session_start`` is replaced.

    A key is cut in slices of about equally many rows, by a job that runs at once (see
    :func:`in_slices`). Inside a slice sessions are found by a window; a slice hands the start and
    end of its last session on, so sessions over any number of slices come out whole. Events of one
    instant are told apart by a hash and need not share a slice.
    """
    if gap_s < 0:
        raise ValueError("a pause is not negative")
    time_type(events, ts)
    rows = require(events, key, ts).drop("session_start")
    rows = in_slices(rows.withColumn("_spread", F.xxhash64(F.monotonically_increasing_id())), [key], [ts, "_spread"])
    order = within_slice([key], [ts, "_spread"])
    pause = seconds_between(F.lag(ts).over(order), F.col(ts))
    # As if no session came in from the slice before.
    begins = F.when(pause.isNull() | (pause > F.lit(gap_s)), F.col(ts))
    started = rows.withColumn("_begins", begins).withColumn(
        "_start",
        F.last("_begins", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )
    slices = slice_totals(
        started, [key], {"_first": F.min(ts), "_last": F.max(ts), "_open": F.max("_start")}
    )
    along = slice_order([key])
    before = seconds_between(F.lag("_last").over(along), F.col("_first"))
    slices = slices.withColumn("_goes_on", F.coalesce(before <= F.lit(gap_s), F.lit(False)))
    # The last session of a slice began in it, unless it is its only one and came in from before.
    own = F.when(~F.col("_goes_on") | (F.col("_open") > F.col("_first")), F.col("_open"))
    slices = slices.withColumn("_own", own)
    handed = F.last("_own", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    carry = slices.select(key, SLICE, "_first", F.when(F.col("_goes_on"), handed).alias("_handed"))
    start = F.when(F.col("_start") == F.col("_first"), F.coalesce("_handed", "_start")).otherwise(F.col("_start"))
    return (
        join_carry(started, carry, [key])
        .withColumn("session_start", start)
        .drop(SLICE, "_spread", "_begins", "_start", "_first", "_handed")
    )


def sessions(
    events: DataFrame, key: str, ts: str, gap_s: float, measures: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per session: ``(key, session_start, session_end, events, length_s, *measures)``.

    ``session_end`` is the time of the last event. ``measures`` are further aggregates by name. See
    :func:`session_starts`; the rows of a session are combined in the tasks before they are shuffled.
    """
    started = session_starts(events, key, ts, gap_s)
    more = [column.alias(name) for name, column in (measures or {}).items()]
    found = started.groupBy(key, "session_start").agg(
        F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("events"), *more
    )
    length = seconds_between(F.col("session_start"), F.col("session_end")).cast("double")
    return found.select(
        key, "session_start", "session_end", "events", length.alias("length_s"), *(measures or {})
    )

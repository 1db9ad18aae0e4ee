"""Values as of each event's own time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from airloom.functions.timing import seconds_between, time_type
from airloom.operators.slices import (
    SLICE,
    earlier_slices,
    in_slices,
    join_carry,
    require,
    slice_order,
    slice_totals,
    within_slice,
)

DIRECTIONS = ("backward", "forward", "nearest")
_ROW, _VALUE, _SIDE, _TIE, _SPREAD = "_row", "_value", "_side", "_tie", "_spread"


def as_of_join(
    events: DataFrame,
    states: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: Mapping[str, str],
    tie: str | None = None,
    direction: str = "backward",
    within_s: float | None = None,
    at_once: bool = True,
) -> DataFrame:
    """``events`` with the values that ``states`` of the same keys had at the time of each.

    ``values`` maps new columns to columns of ``states``; they replace columns of ``events`` of that
    name, and are NULL without a matching state. ``backward`` takes the last state up to the event,
    ``forward`` the first from the event on, ``nearest`` the closer of both, the earlier one if
    they are equally far. Of states at one time, the largest ``tie`` counts as the last. A state at the
    very time of the event counts, unless ``at_once`` is false. With ``within_s``, only states at
    most that many seconds away.

    One row per event, repeated ones included; an event without a key or time has no state. States
    without a key or time are left out. Both sides have their times in ``ts``, of one type.

    Both sides are put in order together, in slices of about equally many rows (see
    :func:`in_slices`; a job that runs at once), whatever the keys are: a key with a third of all
    rows is spread over many tasks, and so are events or states of one instant. Inside a slice the
    last state is carried from row to row, and each slice hands one state on to the next. No pairs
    of events and states are formed. Rows are shuffled by range once and then by slice.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {', '.join(DIRECTIONS)}")
    if direction == "nearest" and not at_once:
        raise ValueError("the nearest state may be at the very time of the event")
    if time_type(events, ts) != time_type(states, ts):
        raise ValueError(f"{ts!r} must be of one type on both sides")
    # Looking back, states come before events of the same time; looking on, after them.
    states_first = at_once == (direction != "forward")
    rows = _together(events, states, keys, ts, values, tie, states_first)
    order = [ts, _SIDE, _TIE, _SPREAD]
    rows = in_slices(rows, keys, order)
    place = F.struct(*order)
    # Only states have a place.
    place = F.when(F.col(_VALUE).isNotNull(), place)
    totals, carried, inside = {}, {}, {}
    slice_by, row_by = slice_order(keys), within_slice(keys, order)
    if direction != "forward":
        totals["_newest"] = F.max_by(_VALUE, place)
        carried["_before"] = _last("_newest", earlier_slices(keys))
        inside["_back"] = _last(_VALUE, row_by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if direction != "backward":
        totals["_oldest"] = F.min_by(_VALUE, place)
        carried["_after"] = _first("_oldest", slice_by.rowsBetween(1, Window.unboundedFollowing))
        inside["_on"] = _first(_VALUE, row_by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    carry = slice_totals(rows, keys, totals).select(
        *keys, SLICE, *(column.alias(name) for name, column in carried.items())
    )
    joined = join_carry(rows.withColumns(inside), carry, keys).where(F.col(_ROW).isNotNull())
    found = _chosen(joined, ts, direction)
    known = F.col(ts).isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    if within_s is not None:
        known = known & (F.abs(_gap(found, F.col(ts))) <= F.lit(within_s))
    kept = [F.col(f"{_ROW}.`{name}`").alias(name) for name in events.columns if name not in values]
    new = [F.when(known, found[name]).alias(name) for name in values]
    return joined.select(*kept, *new)


def status_as_of(
    events: DataFrame,
    statuses: DataFrame,
    key: str,
    ts: str,
    status: str = "status",
    event_id: str = "event_id",
    within_s: float | None = None,
) -> DataFrame:
    """Every event with the ``status`` its key had then, and ``since`` when: NULL if none yet.

    The latest status up to the event counts, by time and then id (see :func:`as_of_join`).
    """
    return as_of_join(events, statuses, [key], ts, {status: status, "since": ts}, event_id, within_s=within_s)


def _together(
    events: DataFrame,
    states: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: Mapping[str, str],
    tie: str | None,
    states_first: bool,
) -> DataFrame:
    """Both sides as rows of one kind: an event has ``_row``, a state ``_value``."""
    whole = F.struct(*(F.col(f"`{name}`") for name in events.columns))
    value = F.struct(F.col(ts).alias("_at"), *(F.col(column).alias(name) for name, column in values.items()))
    asked = events.select(*keys, ts, F.lit(int(states_first)).alias(_SIDE), whole.alias(_ROW))
    known = require(states, *keys, ts).select(
        *keys,
        ts,
        F.lit(int(not states_first)).alias(_SIDE),
        (F.col(tie) if tie else F.lit(None).cast("bigint")).alias(_TIE),
        value.alias(_VALUE),
    )
    rows = asked.unionByName(known, allowMissingColumns=True)
    # Rows that agree in all else are told apart, so that they need not share a slice.
    return rows.withColumn(_SPREAD, F.xxhash64(F.monotonically_increasing_id()))


def _last(name: str, window: WindowSpec) -> Column:
    return F.last(name, ignorenulls=True).over(window)


def _first(name: str, window: WindowSpec) -> Column:
    return F.first(name, ignorenulls=True).over(window)


def _gap(found: Column, moment: Column) -> Column:
    return seconds_between(found["_at"], moment)


def _chosen(joined: DataFrame, ts: str, direction: str) -> Column:
    back = F.coalesce("_back", "_before") if direction != "forward" else None
    on = F.coalesce("_on", "_after") if direction != "backward" else None
    if direction != "nearest":
        return back if on is None else on
    moment = F.col(ts)
    earlier = on.isNull() | (_gap(back, moment) <= -_gap(on, moment))
    return F.when(back.isNotNull() & earlier, back).otherwise(on)

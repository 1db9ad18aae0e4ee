"""Live states that change by the clock, and live forms of sessions and conversions."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone
from functools import lru_cache
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from airloom.functions.timing import as_event_time, as_local_time
from airloom.operators.conversions import lagged, meetings
from airloom.operators.schedule import weekly_intervals
from airloom.operators.slices import require
from airloom.operators.workflow import SOON_SECONDS

#: The state store that timers need; set it in the session of the stream.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}

SECOND = 1_000_000
WEEK = 7 * 86_400 * SECOND
#: From the Thursday of 1970-01-01 back to its Monday.
TO_MONDAY = 3 * 86_400 * SECOND
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def live_sessions(stream: DataFrame, key: str, ts: str, gap_s: int, delay: str) -> DataFrame:
    """Sessions of an unbounded stream: ``(key, session_start, session_end, events)``.

    As in batch, a session goes on while the next event comes at most ``gap_s`` seconds after the last.
    For append mode: a session is given out once, when the watermark has passed the end of its last
    pause. Events more than ``delay`` behind the newest one may be dropped. Rows without a key or
    time are left out. The state has a row per open session; sessions merge as events arrive in
    any order.
    """
    events = require(stream, key, ts).withColumn(ts, as_event_time(stream, ts)).withWatermark(ts, delay)
    # Spark's sessions end where the pause does; that end itself belongs to the next one.
    gap = f"{gap_s * SECOND + 1} microseconds"
    found = events.groupBy(F.session_window(ts, gap).alias("_session"), key).agg(
        F.max(ts).alias("_last"), F.count(F.lit(1)).alias("events")
    )
    return found.select(
        key,
        as_local_time(F.col("_session.start")).alias("session_start"),
        as_local_time(F.col("_last")).alias("session_end"),
        "events",
    )


def live_conversions(
    exposures: DataFrame,
    conversions: DataFrame,
    key: str,
    ts: str,
    within_s: int,
    delay: str,
    event_id: str = "event_id",
) -> DataFrame:
    """Exposures met by conversions of two streams, as :func:`conversions_within` has them in batch.

    For append mode: a pair is given out as soon as both are there. Either side is kept only until
    the other side's watermark, ``delay`` behind its newest event, rules out a further match.
    The state is shared out by key and stretch of time, so that a hot key is spread.
    """
    sides = [
        side.withColumn(ts, as_event_time(side, ts)).withWatermark(ts, delay) for side in (exposures, conversions)
    ]
    pairs = lagged(meetings(*sides, key, ts, within_s, event_id), key)
    return pairs.withColumns({name: as_local_time(F.col(name)) for name in ("exposed_at", "converted_at")})


def live_states(
    stream: DataFrame,
    slots: DataFrame,
    key: str,
    ts: str,
    delay: str,
    idle_days: int,
    status: str = "status",
    event_id: str = "event_id",
    pending: Sequence[str] = ("pending",),
) -> DataFrame:
    """Every change of state, by an event or by the clock: ``(key, at, state, status, since)``.

    The states are those of :func:`current_status` at each moment: ``running`` inside a weekly slot,
    else ``soon`` if one starts within the hour, else ``review`` if the latest status is one of ``pending``,
    else ``ready``. ``status`` and ``since`` are those of the latest event. A row is given out
    when the watermark, ``delay`` behind the newest event, has passed ``at``: then no earlier event can come, and the
    row is final, in whatever order the events arrived. Rows of events that change neither state nor
    status are left out.

    A key without an event for ``idle_days`` leaves: it gets a last row with no state, and its state
    is dropped. The state thus has a row per live key and the events the watermark has not passed yet. A
    timer per key wakes it at its next event or boundary of a slot. ``slots`` are weekly slots as in
    :func:`weekly_intervals`, of each key few; those of a key are read with its events, so a change of them counts from
    its next event on. Rows without a key or time are left out. Times are whole microseconds on a UTC
    clock. For append mode; the session needs ``STATE_STORE``.
    """
    if idle_days < 1:
        raise ValueError("a key is idle after a day at least")
    intervals = weekly_intervals(slots, key).groupBy(F.col(key).alias("_key")).agg(
        F.sort_array(F.collect_set(F.struct("start_m", "end_m"))).alias("_slots")
    )
    events = require(stream, key, ts).select(
        F.col(key).alias("_key"),
        as_event_time(stream, ts).alias("_ts"),
        F.col(event_id).cast("bigint").alias("_id"),
        F.col(status).cast("string").alias("_status"),
    )
    watched = events.withWatermark("_ts", delay).join(intervals, "_key", "left")
    marks = F.transform(
        F.coalesce("_slots", F.array().cast(intervals.schema["_slots"].dataType)),
        lambda slot: F.concat_ws("-", slot.start_m, slot.end_m),
    )
    rows = watched.select("_key", "_ts", "_id", "_status", F.array_join(marks, ",").alias("_slots"))
    kind = dict(events.dtypes)["_key"]
    found = rows.groupBy("_key").transformWithState(
        statefulProcessor=_Clock(tuple(pending), idle_days * 86_400 * SECOND),
        outputStructType=f"_key {kind}, at bigint, state string, status string, since bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
    return found.select(
        F.col("_key").alias(key),
        as_local_time(F.timestamp_micros("at")).alias("at"),
        "state",
        "status",
        as_local_time(F.timestamp_micros("since")).alias("since"),
    )


def _micros(moment: datetime) -> int:
    passed = (moment if moment.tzinfo else moment.astimezone(timezone.utc)) - EPOCH
    return (passed.days * 86_400 + passed.seconds) * SECOND + passed.microseconds


def state_at(moment: int, slots: list[tuple[int, int]], status: str | None, pending: Sequence[str]) -> str:
    """The state at a time in microseconds; slots are in microseconds of the week."""
    now = (moment + TO_MONDAY) % WEEK
    if any(start <= now < end for start, end in slots):
        return "running"
    if any(0 < (start - now) % WEEK <= SOON_SECONDS * SECOND for start, _ in slots):
        return "soon"
    return "review" if status in pending else "ready"


def next_boundary(moment: int, slots: list[tuple[int, int]]) -> int | None:
    """The next time after this at which a slot can change the state."""
    now = (moment + TO_MONDAY) % WEEK
    marks = [mark for start, end in slots for mark in (start - SOON_SECONDS * SECOND, start, end)]
    return min((moment + ((mark - now - 1) % WEEK) + 1 for mark in marks), default=None)


class _Clock(StatefulProcessor):
    """A key's waiting events, its latest event, the state that was last given out and its timer.

    All of it is one text: a call of the state store costs far more than reading that, and so do rows
    of a list state, each of which is a value of its own.
    """

    def __init__(self, pending: tuple[str, ...], idle: int) -> None:
        self.pending, self.idle = pending, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "text string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        came = [[_micros(ts), id_, status, slots] for _, ts, id_, status, slots in rows]
        yield from self._go_on(key, came, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield from self._go_on(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass

    def _go_on(self, key: Any, came: list[list], until: int) -> Iterator[Row]:
        """Everything that happens to a key up to the watermark, in order of time."""
        kept = self.kept.get()
        latest, waiting, timer = json.loads(kept[0]) if kept else (None, [], None)
        waiting = sorted(waiting + came, key=lambda x: (x[0], x[1] is not None, x[1] or 0))
        due = bisect_right(waiting, until, key=lambda x: x[0])
        place = 0
        while True:
            moment = self._next(latest, waiting, place)
            if moment is None or moment > until:
                break
            before = latest
            while place < due and waiting[place][0] == moment:
                latest = (*waiting[place], moment, before[5] if before else None)
                place += 1
            if moment >= latest[0] + self.idle:
                yield self._row(key, moment, None, latest)
                latest = None
                continue
            state = _Week.of(latest[3]).state_at(moment, latest[2], self.pending)
            if before is None or (state, latest[2]) != (before[5], before[2]):
                yield self._row(key, moment, state, latest)
            latest = (*latest[:4], moment, state)
        self._keep(latest, waiting[place:], timer)

    def _next(self, latest: Sequence | None, events: list[list], place: int) -> int | None:
        moments = [events[place][0]] if place < len(events) else []
        if latest:
            boundary = _Week.of(latest[3]).next_boundary(latest[4])
            moments += [latest[0] + self.idle] + ([boundary] if boundary is not None else [])
        return min(moments, default=None)

    def _keep(self, latest: Sequence | None, waiting: list[list], timer: int | None) -> None:
        wake = self._next(latest, waiting, 0)
        wake = None if wake is None else -(-wake // 1000)
        if latest or waiting:
            self.kept.update((json.dumps((latest, waiting, wake)),))
        else:
            self.kept.clear()
        if timer is not None and timer != wake:
            self.handle.deleteTimer(timer)
        if wake is not None and timer != wake:
            self.handle.registerTimer(wake)

    def _row(self, key: Any, at: int, state: str | None, latest: Sequence) -> Row:
        return Row(_key=key[0], at=at, state=state, status=latest[2] if state else None, since=latest[0])


class _Week:
    """The times of the week at which a key's slots change its state, and the state from each on."""

    def __init__(self, text: str) -> None:
        slots = _slots(text)
        moments = {mark % WEEK for start, end in slots for mark in (start - SOON_SECONDS * SECOND, start, end)}
        self.marks = sorted(moments)
        self.states = [state_at(mark - TO_MONDAY, slots, None, ()) for mark in self.marks]

    @staticmethod
    @lru_cache(maxsize=4096)
    def of(text: str) -> _Week:
        return _Week(text)

    def state_at(self, moment: int, status: str | None, pending: Sequence[str]) -> str:
        """As the function of that name."""
        now = (moment + TO_MONDAY) % WEEK
        # Before the first mark the week goes on as the last one ended.
        state = self.states[bisect_right(self.marks, now) - 1] if self.marks else "ready"
        return "review" if state == "ready" and status in pending else state

    def next_boundary(self, moment: int) -> int | None:
        """As the function of that name."""
        if not self.marks:
            return None
        now = (moment + TO_MONDAY) % WEEK
        place = bisect_right(self.marks, now)
        mark = self.marks[place] if place < len(self.marks) else self.marks[0] + WEEK
        return moment + mark - now


def _slots(text: str) -> list[tuple[int, int]]:
    pairs = (part.split("-") for part in text.split(",") if part)
    return [(int(start) * 60 * SECOND, int(end) * 60 * SECOND) for start, end in pairs]

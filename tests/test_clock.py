from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest

from airloom.operators import current_status
from airloom.streaming import STATE_STORE, live_states
from airloom.streaming.clock import _Clock, _Week, next_boundary, state_at
from tests.conftest import rows_of
from tests.test_streaming import DDL, collect

SLOTS = "user_id bigint, dow int, start_h double, end_h double, enabled boolean"
MONDAY = datetime(2024, 1, 1)


@pytest.fixture
def session(spark):
    own = spark.newSession()
    for name, value in {**STATE_STORE, "spark.sql.shuffle.partitions": "2"}.items():
        own.conf.set(name, value)
    return own


@pytest.fixture
def states(session, frame, tmp_path):
    """``states(batches, slots, idle_days)``: all changes of state, the batches streamed one by one."""

    def run(batches, slots, idle_days=30):
        for number, rows in enumerate(batches):
            frame(rows, DDL).coalesce(1).write.parquet(str(tmp_path / "in" / f"part-{number}"))
        slots_path = str(tmp_path / "slots")
        frame(slots, SLOTS).write.parquet(slots_path)
        stream = (
            session.readStream.schema(DDL).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
            .parquet(str(tmp_path / "in"))
        )
        found = live_states(stream, session.read.parquet(slots_path), "user_id", "ts", "1 hour", idle_days)
        return collect(session, found, tmp_path)

    return run


def test_states_change_without_an_event(states):
    """A slot on Monday from 12 to 14: soon from 11 on, running, then back to what the status says."""
    batches = [
        [(1, "2024-01-01 10:00:00", 1, "pending"), (2, "2024-01-01 10:30:00", 2, "done")],
        [(3, "2024-01-01 13:00:00", 1, "done")],
        [(9, "2024-01-02 00:00:00", 99, "far")],  # brings the watermark to 23:00
    ]
    found = states(batches, [(1, 1, 12.0, 14.0, True), (2, 1, 11.0, 12.0, False)])
    at = lambda text: datetime.fromisoformat(f"2024-01-01 {text}")
    assert rows_of(found.where("user_id <> 99")) == [
        (1, at("10:00"), "review", "pending", at("10:00")),
        (1, at("11:00"), "soon", "pending", at("10:00")),
        (1, at("12:00"), "running", "pending", at("10:00")),
        (1, at("13:00"), "running", "done", at("13:00")),
        (1, at("14:00"), "ready", "done", at("13:00")),
        (2, at("10:30"), "ready", "done", at("10:30")),
    ]


def test_replay_equals_the_batch_state_at_each_change(states, spark, frame):
    rng = random.Random(5)
    events = [
        (i, str(MONDAY + timedelta(minutes=rng.randrange(4 * 1440), microseconds=rng.choice([0, 1, 999_999]))), rng.choice([1, 1, 2, 3]), rng.choice(["pending", "done"]))
        for i in range(120)
    ]
    slots = [(1, 1, 9.0, 17.5, True), (1, 2, 22.0, 3.0, True), (2, 4, 8.0, 10.0, True), (2, 4, 9.0, 12.0, True), (2, 7, 23.0, 1.0, True)]
    # Within the watermark's delay of an hour, events may come in any order.
    events.sort(key=lambda e: datetime.fromisoformat(e[1]) + timedelta(minutes=rng.randrange(50)))
    batches = [events[i : i + 20] for i in range(0, len(events), 20)]
    end = MONDAY + timedelta(days=6)
    found = sorted((tuple(r) for r in states([*batches, [(999, str(end), 99, "far")]], slots).where("user_id <> 99").collect()), key=lambda r: (r[1], r[0]))
    all_events, all_slots = frame(events, DDL), frame(slots, SLOTS)
    assert len(found) > 60 and {r[2] for r in found} == {"running", "soon", "review", "ready"}
    moments = sorted({r[1] for r in found})
    for moment in [*moments[:: max(1, len(moments) // 12)], moments[-1]]:
        batch = current_status(all_events, "user_id", "ts", moment, pending=["pending"], slots=all_slots)
        expected = {r.user_id: (r.state, r.status) for r in batch.where("status IS NOT NULL").collect()}
        live = {}
        for user, at, state, status, _ in found:
            if at <= moment:
                live[user] = state, status
        assert live == expected, moment


def test_idle_keys_leave_and_may_come_back(states):
    batches = [
        [(1, "2024-01-01 10:00:00", 1, "pending"), (2, "2024-01-01 11:00:00", 2, "done")],
        [(3, "2024-01-02 12:00:00", 2, "done")],
        [(4, "2024-01-05 09:00:00", 1, "done")],
        [(9, "2024-01-05 12:00:00", 99, "far")],
    ]
    found = rows_of(states(batches, [], 1).where("user_id <> 99"))
    time = datetime.fromisoformat
    first, again = time("2024-01-01 10:00"), time("2024-01-05 09:00")
    assert found == [
        (1, first, "review", "pending", first),
        (1, first + timedelta(days=1), None, None, first),
        (1, again, "ready", "done", again),
        (2, time("2024-01-01 11:00"), "ready", "done", time("2024-01-01 11:00")),
        (2, time("2024-01-02 11:00"), None, None, time("2024-01-01 11:00")),
        (2, time("2024-01-02 12:00"), "ready", "done", time("2024-01-02 12:00")),
        (2, time("2024-01-03 12:00"), None, None, time("2024-01-02 12:00")),
    ]


def test_state_does_not_grow_with_keys_that_left(session, frame, tmp_path):
    """A thousand keys, a hundred a day: only those of the last days have state."""
    for day in range(10):
        rows = [(n, str(MONDAY + timedelta(days=day)), n, "done") for n in range(day * 100, day * 100 + 100)]
        frame(rows, DDL).coalesce(1).write.parquet(str(tmp_path / "in" / f"part-{day}"))
    stream = session.readStream.schema(DDL).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    found = live_states(stream, frame([], SLOTS), "user_id", "ts", "1 hour", 2)
    query = found.writeStream.outputMode("append").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # A key has a few rows of state: its latest event, waiting events and a timer.
    assert kept and kept[-1] < 400 * 6 < 1000 * 3


def test_boundaries():
    hour, second = 3600 * 10**6, 10**6
    monday = 4 * 24 * hour  # 1970-01-05
    slots = [(12 * hour, 14 * hour)]
    seen = [monday]
    for _ in range(4):
        seen.append(next_boundary(seen[-1], slots))
    assert [(t - monday) // hour for t in seen] == [0, 11, 12, 14, 7 * 24 + 11]
    states = [state_at(monday + t, slots, "p", ["p"]) for t in (0, 11 * hour - 1, 11 * hour, 12 * hour, 14 * hour - second, 14 * hour)]
    assert states == ["review", "review", "soon", "running", "running", "review"]
    assert next_boundary(monday, []) is None and state_at(monday, [], None, ["p"]) == "ready"


def test_the_weeks_table_says_what_the_slots_say():
    rng, minute = random.Random(9), 60_000_000
    for text in ["", "0-10080", "30-45", "0-60,10000-10080", "600-700,730-900,5000-5001"]:
        week, slots = _Week(text), [tuple(int(x) * minute for x in part.split("-")) for part in text.split(",") if part]
        edges = [x + step for slot in slots for x in slot for step in (-60 * minute, -1, 0, 1)]
        for moment in edges + [rng.randrange(3 * 10080 * minute) for _ in range(50)]:
            for status in ("p", None):
                assert week.state_at(moment, status, ["p"]) == state_at(moment, slots, status, ["p"])
            assert week.next_boundary(moment) == next_boundary(moment, slots)


def test_a_key_costs_few_calls_of_the_state_store():
    """However many events wait: one read, one write and one timer."""
    calls = []

    class Store:
        text = None

        def getValueState(self, name, schema):
            return self

        def get(self):
            calls.append("get")
            return self.text

        def update(self, value):
            calls.append("update")
            self.text = value

        def registerTimer(self, moment):
            calls.append("timer")

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    clock = _Clock(("p",), 86_400_000_000)
    clock.init(Store())
    rows = [(1, datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=n), n, "p", "0-60") for n in range(500)]
    assert list(clock.handleInputRows((1,), iter(rows), Times())) == []
    assert calls == ["get", "update", "timer"]
    assert list(clock.handleInputRows((1,), iter([]), Times())) == []
    assert calls == ["get", "update", "timer", "get", "update"]

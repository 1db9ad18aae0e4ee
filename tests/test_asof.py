from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from airloom.operators import as_of_join, status_as_of
from tests.conftest import rows_of

EVENTS = "event_id bigint, key bigint, ts timestamp_ntz, note string"
STATES = "key bigint, ts timestamp_ntz, event_id bigint, status string"
START = datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else str(START + timedelta(seconds=seconds))


def plain(events, states, direction="backward", within_s=None, at_once=True):
    """Per event, a look at every state of its key."""
    found = []
    for event_id, key, ts, note in events:
        best = None
        for state_key, state_ts, tie, status in states:
            if None in (key, ts, state_key, state_ts) or key != state_key:
                continue
            gap = ts - state_ts
            if (gap == 0 and not at_once) or (within_s is not None and abs(gap) > within_s):
                continue
            if (direction == "backward" and gap < 0) or (direction == "forward" and gap > 0):
                continue
            # Nearer first, then back before on; the last of several going back, the first going on.
            tie = -1 if tie is None else tie
            rank = (abs(gap), gap < 0, -tie if gap > 0 or (gap == 0 and direction != "forward") else tie)
            if best is None or rank < best[0]:
                best = rank, status, state_ts
        found.append((event_id, key, at(ts), note, best and best[1], at(best[2]) if best else None))
    return sorted(map(str, found))


def joined(frame, events, states, **options):
    left = frame([(i, k, at(t), n) for i, k, t, n in events], EVENTS)
    right = frame([(k, at(t), i, s) for k, t, i, s in states], STATES)
    found = as_of_join(left, right, ["key"], "ts", {"status": "status", "since": "ts"}, "event_id", **options)
    assert found.columns == ["event_id", "key", "ts", "note", "status", "since"]
    found = found.withColumns({name: F.col(name).cast("string") for name in ("ts", "since")})
    return sorted(map(str, (tuple(row) for row in found.collect())))


def data(seed, n=600, hot=True):
    rng = random.Random(seed)
    key = lambda: 1 if hot and rng.random() < 0.5 else rng.choice([2, 3, 4, None])
    ts = lambda: rng.choice([None, *range(0, 2000, 7), *[500] * 40])
    events = [(i, key(), ts(), rng.choice(["x", None])) for i in range(n)]
    states = [(key(), ts(), i, f"s{i}") for i in range(n // 3)]
    return events + events[:5], states


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("within_s", [None, 20])
def test_equals_a_look_at_every_state(frame, direction, within_s):
    events, states = data(1)
    options = {"direction": direction, "within_s": within_s}
    assert joined(frame, events, states, **options) == plain(events, states, **options)


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_states_of_the_very_time_may_be_left_out(frame, direction):
    events, states = data(2)
    options = {"direction": direction, "at_once": False}
    assert joined(frame, events, states, **options) == plain(events, states, **options)


@pytest.mark.parametrize("slices", [1, 3, 40])
def test_any_number_of_slices(spark, frame, slices):
    """With many slices a state is handed on over slices that have none of their own."""
    events, states = data(3, 400)
    states = states[:6]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        for direction in ("backward", "nearest"):
            assert joined(frame, events, states, direction=direction) == plain(events, states, direction)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_hot_key_and_one_instant_are_spread(spark, frame):
    rows = [(i, 1, 100, None) for i in range(4000)] + [(i, 1, i, None) for i in range(4000)]
    left = frame([(i, k, at(t), n) for i, k, t, n in rows], EVENTS)
    right = frame([(1, at(100), 1, "a"), (1, at(2000), 2, "b")], STATES)
    found = status_as_of(left, right, "key", "ts")
    counts = {r.status: r["count"] for r in found.groupBy("status").count().collect()}
    assert counts == {None: 100, "a": 4000 + 1900, "b": 2000}
    from airloom.operators import asof

    together = asof._together(left, right, ["key"], "ts", {"status": "status"}, "event_id", True)
    cut = asof.in_slices(together, ["key"], ["ts", "_side", "_tie", "_spread"])
    sizes = [r["count"] for r in cut.groupBy("_slice").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 8002 / 8


def test_no_rows_on_either_side(frame):
    events, states = data(4, 30)
    assert joined(frame, events, []) == plain(events, [])
    assert joined(frame, [], states) == []


def test_several_keys_and_clashing_names(frame):
    left = frame([(1, "2024-01-01 10:00:00", 7, "old", "x")], "a bigint, ts timestamp_ntz, _row bigint, status string, _value string")
    right = frame([(1, "2024-01-01 09:00:00", "new", 3), (1, "2024-01-01 09:00:00", "newer", 4)], "a bigint, ts timestamp_ntz, status string, n bigint")
    left, right = (df.withColumn("b", F.lit("k")) for df in (left, right))
    found = as_of_join(left, right, ["a", "b"], "ts", {"status": "status"}, "n").select("a", "b", "_row", "_value", "status")
    assert rows_of(found) == [(1, "k", 7, "x", "newer")]


def test_wrong_options_are_refused(frame):
    left = frame([(1, 1, at(0), None)], EVENTS)
    right = frame([(1, at(0), 1, "a")], STATES)
    for options in ({"direction": "sideways"}, {"direction": "nearest", "at_once": False}):
        with pytest.raises(ValueError):
            as_of_join(left, right, ["key"], "ts", {"s": "status"}, **options)
    with pytest.raises(ValueError):
        as_of_join(left, right.withColumn("ts", F.col("ts").cast("timestamp")), ["key"], "ts", {"s": "status"})


def test_one_range_shuffle_and_no_pairs(spark, frame):
    events, states = data(5, 50)
    left = frame([(i, k, at(t), n) for i, k, t, n in events], EVENTS)
    right = frame([(k, at(t), i, s) for k, t, i, s in states], STATES)
    found = status_as_of(left, right, "key", "ts")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("rangepartitioning") == 0
    assert plan.count("Scan parquet") <= 2  # the slices, for the rows and for what they hand on

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from airloom import operators as ops
from airloom.operators.slices import SLICE, in_slices
from tests.conftest import rows_of

STATUS = "content_id bigint, ts timestamp_ntz, event_id bigint, status string"
SLOTS = "blogger_id bigint, dow int, start_h double, end_h double, enabled boolean"


def test_capacity_exact_fit_short_none_and_duplicates(frame):
    demand = frame([(1, 2), (2, 2), (2, 1), (3, 1), (4, 0)], "blogger_id bigint, n bigint")
    supply = frame(
        [(1, 10), (1, 11), (1, 11), (2, 10), (2, 10), (2, None), (9, 1)],
        "blogger_id bigint, item_id bigint",
    )
    assert rows_of(ops.capacity_check(demand, supply, "blogger_id")) == [
        (1, 2, 2, True, 0),
        (2, 3, 1, False, 2),
        (3, 1, 0, False, 1),
        (4, 0, 0, True, 0),
    ]


@pytest.mark.parametrize("slice_width", [None, 1, 7, 1000])
def test_shared_pool_marks_the_first_overflow(frame, slice_width):
    rng = random.Random(slice_width)
    rows = [
        (1 if n % 3 == 0 else rng.randrange(2, 5), rng.randrange(1, 4), n, rng.randrange(0, 4))
        for n in range(200)
    ]
    demand = frame(rows, "pool bigint, priority int, key bigint, n bigint")
    supply = frame(
        [(pool, item) for pool in (1, 2, 3) for item in range(20 * pool)] * 2,
        "pool bigint, item_id bigint",
    )
    result = ops.shared_capacity_check(
        demand, supply, "pool", "priority", "key", slice_width=slice_width
    )
    expected = []
    for pool in {row[0] for row in rows}:
        running, usable, overflowed = 0, 20 * pool if pool < 4 else 0, False
        for _, priority, key, n in sorted(row for row in rows if row[0] == pool):
            running += n
            first = running > usable and not overflowed
            overflowed |= first
            expected.append((pool, priority, key, n, running, usable, running <= usable, first))
    columns = ["pool", "priority", "key", "n", "running_need", "usable", "fits", "overflows"]
    assert sorted(map(tuple, result.select(columns).collect())) == sorted(expected)


def test_sources_with_and_without_items(frame):
    sources = frame([(1,), (2,)], "blogger_id bigint")
    items = frame([(1,), (1,), (3,), (None,)], "blogger_id bigint")
    assert rows_of(ops.source_readiness(sources, items, "blogger_id")) == [(1,)]
    assert rows_of(ops.source_readiness(sources, items, "blogger_id", ready=False)) == [(2,)]


def test_batch_progress(frame):
    df = frame(
        [
            (1, 1, "script", True),
            (1, 2, "voice", False),
            (1, 3, "cut", False),
            (2, 1, "script", True),
            (3, 5, "cut", None),
            (3, 5, "audio", False),
        ],
        "batch bigint, ord int, phase string, done boolean",
    )
    progress = ops.batch_progress(df, "batch", "ord", "done", "phase")
    assert rows_of(progress) == [
        (1, 1, 3, 1 / 3, 2, "voice"),
        (2, 1, 1, 1.0, None, None),
        (3, 0, 2, 0.0, 5, "audio"),
    ]
    assert rows_of(ops.batch_progress(df, "batch", "ord", "done"))[0][3] == 2


@pytest.mark.parametrize("slice_minutes", [None, 1, 60, 100000])
def test_queue_position_over_slices(frame, slice_minutes):
    rng = random.Random(1)
    start = datetime(2024, 1, 1)
    rows = []
    for n in range(300):
        queue = "hot" if n % 3 == 0 else rng.choice(["a", "b"])
        moment = start + timedelta(minutes=rng.randrange(0, 300))
        rows.append((n, queue, str(moment), rng.random() < 0.3))
    rows += [(900, None, str(start), False), (901, "a", None, False), (902, "c", str(start), None)]
    df = frame(rows, "key bigint, queue string, queued_at timestamp_ntz, done boolean")
    result = ops.queue_position(df, "queue", "queued_at", "key", "done", slice_minutes)
    waiting = sorted((q, t, k) for k, q, t, done in rows if q and t and not done)
    expected, place = [], {}
    for queue, _, key in waiting:
        place[queue] = place.get(queue, 0) + 1
        expected.append((key, queue, place[queue]))
    found = result.select("key", "queue", "position").collect()
    assert sorted(map(tuple, found)) == sorted(expected)


@pytest.mark.parametrize("slice_minutes", [None, 1, 60, 100000])
def test_history_crosses_slices(frame, slice_minutes):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    rows = [(7, str(start), 5000, "only")]
    for n in range(300):
        key = 1 if n % 3 == 0 else rng.randrange(2, 6)
        moment = start + timedelta(seconds=rng.randrange(0, 20000, 10))
        rows.append((key, str(moment), n, rng.choice(["x", "y", None])))
    rows += [(None, str(start), 6000, "x"), (1, None, 6001, "x")]
    history = ops.status_history(frame(rows, STATUS), "content_id", "ts", "status",
                                 slice_minutes=slice_minutes)
    expected = {}
    ordered = sorted(row for row in rows if row[0] is not None and row[1] is not None)
    for index, (key, ts, event_id, _) in enumerate(ordered):
        before = ordered[index - 1] if index and ordered[index - 1][0] == key else None
        after = ordered[index + 1] if index + 1 < len(ordered) else None
        after = after if after and after[0] == key else None
        moment = datetime.fromisoformat
        expected[event_id] = (
            before and before[3],
            after and moment(after[1]),
            after and (moment(after[1]) - moment(ts)).total_seconds(),
        )
    found = {r.event_id: (r.prev_status, r.next_ts, r.dwell_s) for r in history.collect()}
    assert found == expected


def test_current_status_precedence(frame):
    # 2024-01-03 is a Wednesday.
    events = frame(
        [
            (1, "2024-01-02 10:00:00", 1, "pending"),
            (2, "2024-01-02 10:00:00", 2, "pending"),
            (2, "2024-01-02 10:00:00", 3, "done"),  # same time: the later id counts
            (3, "2024-01-01 10:00:00", 5, "pending"),
            (3, "2024-01-03 23:00:00", 6, "done"),  # after the moment
            (4, "2024-01-03 12:00:00", 7, "done"),  # at the moment
            (5, "2024-01-01 10:00:00", 8, "pending"),
            (6, "2024-01-04 10:00:00", 9, "pending"),  # unknown until later
            (8, "2024-01-01 10:00:00", 10, "pending"),
        ],
        STATUS.replace("content_id", "blogger_id"),
    )
    moment = "2024-01-03 12:00:00"
    states = ops.current_status(events, "blogger_id", "ts", moment)
    assert {row.blogger_id: row.state for row in states.collect()} == {
        1: "review",
        2: "ready",
        3: "review",
        4: "ready",
        5: "review",
        8: "review",
    }
    slots = frame(
        [
            (1, 3, 12.0, 13.0, True),  # starts now
            (2, 3, 13.0, 14.0, True),  # in exactly an hour
            (3, 3, 11.0, 12.0, True),  # just over
            (4, 3, 13.25, 14.0, True),  # too far off
            (5, 3, 11.0, 14.0, False),  # disabled
            (7, 2, 20.0, 13.0, True),  # since yesterday; no events
        ],
        SLOTS,
    )
    states = ops.current_status(events, "blogger_id", "ts", datetime(2024, 1, 3, 12), slots=slots)
    assert {row.blogger_id: row.state for row in states.collect()} == {
        1: "running",
        2: "soon",
        3: "review",
        4: "ready",
        5: "review",
        7: "running",
        8: "review",
    }


def test_soon_looks_past_sunday_night(frame):
    events = frame([(1, "2024-01-01 10:00:00", 1, "x")], STATUS.replace("content_id", "blogger_id"))
    slots = frame([(1, 1, 0.5, 2.0, True)], SLOTS)
    for moment, state in [
        ("2024-01-07 23:40:00", "soon"),
        ("2024-01-07 23:30:00", "soon"),
        ("2024-01-07 23:29:59.999999", "ready"),
        ("2024-01-08 00:29:59.999999", "soon"),
        ("2024-01-08 00:30:00", "running"),
    ]:
        found = ops.current_status(events, "blogger_id", "ts", moment, slots=slots)
        assert found.first().state == state


def test_checklist_is_a_division(frame):
    checks = frame(
        [(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "z"), (1, "z"), (4, None)],
        "content_id bigint, check string",
    )
    required = frame([("a",), ("b",), ("b",)], "check string")
    result = ops.checklist_complete(checks, required, "content_id")
    assert rows_of(result) == [
        (1, 2, 2, True),
        (2, 1, 2, False),
        (3, 0, 2, False),
        (4, 0, 2, False),
    ]
    only = ops.checklist_complete(checks, required, "content_id", only_complete=True)
    assert rows_of(only) == [(1, 2, 2, True)]
    nothing = ops.checklist_complete(checks, required.where("false"), "content_id")
    assert {row.complete for row in nothing.collect()} == {True}


def test_return_reasons_share_of_items(frame):
    df = frame(
        [(1, ["a", "b", "a"]), (1, ["a"]), (2, ["a", None]), (3, []), (4, None)],
        "content_id bigint, reasons array<string>",
    )
    result = ops.return_reasons(df, "content_id", "reasons")
    assert rows_of(result) == [("a", 2, 0.5), ("b", 1, 0.25)]


def test_content_profile_edges(frame):
    items = frame([(1, 0), (2, 99), (3, 100), (4, 250), (5, None)], "item_id bigint, length bigint")
    scores = frame([(1, 1.0), (3, 0.5), (4, 1.5), (9, 7.0)], "item_id bigint, score double")
    result = ops.content_profile(items, scores, "item_id", "length", [100, 200], median=True)
    columns = ["bucket", "items", "scored", "mean_score", "median_score", "coverage"]
    assert rows_of(result.select(columns)) == [
        (0, 2, 1, 1.0, 1.0, 0.5),
        (1, 1, 1, 0.5, 0.5, 1.0),
        (2, 1, 1, 1.5, 1.5, 1.0),
        (None, 1, 0, None, None, 0.0),
    ]
    with pytest.raises(ValueError):
        ops.content_profile(items, scores, "item_id", "length", [2, 1])


def test_new_entities(frame):
    df = frame(
        [
            (1, "2024-01-01 00:00:00"),
            (1, "2024-01-09 00:00:00"),
            (2, "2024-01-03 00:00:00"),  # exactly n days old: no longer new
            (3, "2024-01-03 00:00:01"),
            (4, "2024-01-10 00:00:01"),
        ],
        "key bigint, ts timestamp_ntz",
    )
    result = ops.new_entities(df, "key", "ts", "2024-01-10", 7).select("key", "is_new")
    assert rows_of(result) == [(1, False), (2, False), (3, True)]


def test_zoned_times_work_too(frame):
    rows = [(1, "2024-01-01 10:00:00", 1, "a"), (1, "2024-01-01 12:30:00", 2, "b")]
    zoned = frame(rows, STATUS.replace("timestamp_ntz", "timestamp"))
    history = ops.status_history(zoned, "content_id", "ts", "status")
    assert rows_of(history.select("event_id", "prev_status", "dwell_s")) == [
        (1, None, 9000.0),
        (2, "a", None),
    ]
    with pytest.raises(ValueError):
        ops.queue_position(zoned.withColumn("ts", F.lit("x")), "status", "ts", "event_id")


def test_one_instant_of_one_queue_is_numbered_by_several_tasks(spark):
    # 30,000 items queued at once, with keys a million apart.
    waiting = spark.range(30_000).select(
        (F.col("id") * 1_000_000).alias("key"),
        F.lit("hot").alias("queue"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("queued_at"),
    )
    cut = in_slices(waiting, ["queue"], ["queued_at", "key"])
    sizes = [row["count"] for row in cut.groupBy(SLICE).count().collect()]
    assert len(sizes) >= 6
    assert max(sizes) < 10_000
    placed = ops.queue_position(waiting, "queue", "queued_at", "key")
    assert placed.where("position * 1000000 - 1000000 = key").count() == 30_000


def test_shared_pool_with_sparse_keys_has_few_slices(spark):
    demand = spark.range(20_000).select(
        F.lit(1).alias("pool"),
        F.lit(1).alias("priority"),
        (F.col("id") * 1_000_000).alias("key"),
        F.lit(1).alias("n"),
    )
    supply = spark.range(15_000).select(F.lit(1).alias("pool"), F.col("id").alias("item_id"))
    checked = ops.shared_capacity_check(demand, supply, "pool", "priority", "key")
    found = checked.agg(
        F.count_if(F.col("running_need") * 1_000_000 == F.col("key") + 1_000_000).alias("right"),
        F.count_if("fits").alias("fits"),
        F.sum(F.when(F.col("overflows"), F.col("running_need"))).alias("first"),
    ).first()
    assert tuple(found) == (20_000, 15_000, 15_001)
    cut = in_slices(demand, ["pool"], ["priority", "key"])
    assert 6 <= cut.select(SLICE).distinct().count() <= 8


def test_returned_items_without_reasons_count_in_the_base(frame):
    df = frame(
        [(1, ["a", "b", "a"]), (1, ["a"]), (2, []), (3, None), (4, [None, "b"]), (None, ["a"])],
        "item bigint, reasons array<string>",
    )
    assert rows_of(ops.return_reasons(df, "item", "reasons")) == [("a", 1, 0.25), ("b", 2, 0.5)]

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from airloom import operators as ops
from tests.conftest import rows_of

STAGES = ["view", "click", "signup", "purchase"]
DDL = "user_id bigint, ts timestamp_ntz, event_type string"


def reached(events):
    """Stages reached by one subject, event by event: (time, type) pairs in any order."""
    at, since = 0, None
    for ts, kind in sorted(events):
        if at < len(STAGES) and kind == STAGES[at] and (since is None or ts > since):
            at, since = at + 1, ts
    return at


def day_of(df):
    return df.withColumn("day", F.to_date("ts"))


def test_order_ties_repeats_and_midnight(frame):
    events = day_of(
        frame(
            [
                (1, "2024-01-01 10:00:00", "click"),  # before the view: does not count
                (1, "2024-01-01 10:05:00", "view"),
                (2, "2024-01-01 10:00:00", "view"),  # same instant: not strictly after
                (2, "2024-01-01 10:00:00", "click"),
                (3, "2024-01-01 10:00:00", "view"),
                (3, "2024-01-01 10:00:00", "view"),
                (3, "2024-01-01 10:01:00", "view"),
                (3, "2024-01-01 10:02:00", "click"),
                (3, "2024-01-01 10:02:30", "click"),
                (4, "2024-01-01 10:00:00", "view"),  # skips the click
                (4, "2024-01-01 11:00:00", "signup"),
                (5, "2024-01-01 23:59:00", "view"),  # goes on after midnight
                (5, "2024-01-02 00:01:00", "click"),
                (6, "2024-01-01 01:00:00", "view"),
                (6, "2024-01-01 08:00:00", "click"),
                (6, "2024-01-01 15:00:00", "signup"),
                (6, "2024-01-01 15:00:00.000001", "purchase"),
                (7, None, "view"),
                (None, "2024-01-01 10:00:00", "view"),
                (8, "2024-01-01 10:00:00", "error"),
            ],
            DDL,
        )
    )
    funnel = ops.ordered_funnel(events, ["user_id", "day"], "ts", "event_type", STAGES)
    assert rows_of(funnel) == [
        (1, "view", 6),
        (2, "click", 2),
        (3, "signup", 1),
        (4, "purchase", 1),
    ]


@pytest.mark.parametrize("slice_minutes", [1, 5, 60, 1440])
def test_any_slicing_equals_the_walk_over_events(spark, frame, slice_minutes):
    rng = random.Random(slice_minutes)
    start = datetime(2024, 3, 1, 12)
    rows = []
    for number in range(3000):
        user = 0 if number % 3 == 0 else rng.randrange(1, 300)  # one subject has a third
        moment = start + timedelta(seconds=rng.randrange(0, 7200, 15))
        rows.append((user, str(moment), rng.choice(STAGES)))
    events = frame(rows, DDL)
    result = ops.funnel_reach(events, ["user_id"], "ts", "event_type", STAGES, slice_minutes)
    by_user = {}
    for user, ts, kind in rows:
        by_user.setdefault(user, []).append((ts, kind))
    assert dict(rows_of(result)) == {user: reached(own) for user, own in by_user.items()}


def test_counts_never_grow_along_the_funnel(spark):
    from airloom.plans.queries import QUERIES

    counts = [row[2] for row in rows_of(ops_select(QUERIES["ordered_funnel"], spark))]
    assert counts == sorted(counts, reverse=True)


def ops_select(query, spark):
    return query(spark, "/root/testdata/sf0.001").select("stage", "event_type", "subjects")


def test_stage_nobody_reached_and_rates_at_zero(frame):
    events = day_of(frame([(1, "2024-01-01 10:00:00", "click")], DDL))
    funnel = ops.ordered_funnel(events, ["user_id", "day"], "ts", "event_type", STAGES)
    assert rows_of(ops.funnel_transitions(funnel)) == [
        (1, "view", 0, None, None, None, None),
        (2, "click", 0, 0, None, None, 0),
        (3, "signup", 0, 0, None, None, 0),
        (4, "purchase", 0, 0, None, None, 0),
    ]


def test_split_keeps_subjects_without_the_attribute(frame):
    events = day_of(
        frame(
            [
                (1, "2024-01-01 10:00:00", "view"),
                (1, "2024-01-01 10:01:00", "click"),
                (2, "2024-01-01 10:00:00", "view"),
            ],
            DDL,
        )
    )
    subjects = frame([(1, "a")], "user_id bigint, type string")
    split = ops.funnel_split(
        events, subjects, "user_id", "type", ["user_id", "day"], "ts", "event_type", STAGES[:2]
    )
    assert rows_of(split.select("type", "stage", "subjects", "step_rate")) == [
        ("a", 1, 1, None),
        ("a", 2, 1, 1.0),
        (None, 1, 1, None),
        (None, 2, 0, 0.0),
    ]
    with pytest.raises(ValueError):
        ops.funnel_split(events, subjects, "day_", "type", ["user_id"], "ts", "event_type", STAGES)


@pytest.mark.parametrize("stages", [[], ["view", "view"]])
def test_bad_stages_are_refused(frame, stages):
    with pytest.raises(ValueError):
        ops.ordered_funnel(frame([], DDL), ["user_id"], "ts", "event_type", stages)

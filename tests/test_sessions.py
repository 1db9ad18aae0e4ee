from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from airloom.operators import session_starts, sessions
from airloom.streaming import live_sessions
from tests.conftest import rows_of
from tests.test_streaming import collect, feed  # noqa: F401

DDL = "event_id bigint, ts timestamp_ntz, user_id bigint, status string"
START = datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


def plain(rows, gap):
    """Per user the events in order, cut at each pause."""
    by_user = defaultdict(list)
    for _, seconds, user, _ in rows:
        if seconds is not None and user is not None:
            by_user[user].append(seconds)
    found = []
    for user, times in by_user.items():
        current = []
        for t in sorted(times):
            if current and t - current[-1] > gap:
                found.append((user, at(current[0]), at(current[-1]), len(current)))
                current = []
            current.append(t)
        found.append((user, at(current[0]), at(current[-1]), len(current)))
    return sorted(found)


def data(seed, n=500):
    rng = random.Random(seed)
    return [
        (i, rng.choice([None, *[rng.randrange(0, 40_000) for _ in range(9)], 777]), 1 if rng.random() < 0.5 else rng.choice([2, 3, None]), "a")
        for i in range(n)
    ]


def framed(frame, rows):
    return frame([(i, t if t is None else str(at(t)), u, s) for i, t, u, s in rows], DDL)


@pytest.mark.parametrize("gap", [0, 60, 300, 100_000])
@pytest.mark.parametrize("slices", [1, 8, 30])
def test_sessions_equal_a_walk(spark, frame, gap, slices):
    rows = data(gap)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        found = sessions(framed(frame, rows), "user_id", "ts", gap)
        assert sorted(tuple(r)[:4] for r in found.collect()) == plain(rows, gap)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_session_over_many_slices_and_one_after_it(frame):
    rows = [(i, i * 10, 1, "a") for i in range(2000)] + [(5000, 30_000, 1, "b"), (5001, 30_010, 1, "b")]
    found = sessions(framed(frame, rows), "user_id", "ts", 10, {"kinds": F.count_distinct("status")})
    assert rows_of(found.select("events", "length_s", "kinds")) == [(2, 10.0, 1), (2000, 19_990.0, 1)]


def test_every_row_knows_its_session(frame):
    rows = [(1, 0, 1, "a"), (2, 10, 1, "a"), (3, 21, 1, "a"), (4, None, 1, "a"), (5, 5, None, "a")]
    df = framed(frame, rows).withColumn("session_start", F.lit("old"))
    found = session_starts(df, "user_id", "ts", 10).select("event_id", "session_start")
    assert rows_of(found) == [(1, at(0)), (2, at(0)), (3, at(21))]
    assert sessions(df.limit(0), "user_id", "ts", 10).count() == 0
    with pytest.raises(ValueError):
        session_starts(df, "user_id", "ts", -1)


def test_live_sessions_equal_batch_on_closed_ones(spark, frame, feed, tmp_path):  # noqa: F811
    rows = [r for r in data(9, 300) if r[1] is not None] + [(900, 100, 2, "x"), (901, 400, 2, "x"), (902, 701, 2, "x")]
    rng = random.Random(4)
    rows.sort(key=lambda r: r[1] + rng.randrange(600))  # at most ten minutes out of order
    last = max(r[1] for r in rows)
    end = [(10_000, last + 5000, 99, "end")]
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)] + [end]
    stream = feed(*([(i, str(at(t)), u, s) for i, t, u, s in part] for part in batches))
    found = collect(spark, live_sessions(stream, "user_id", "ts", 300, "10 minutes"), tmp_path)
    closed = [x for x in plain(rows, 300)]
    assert sorted(tuple(r) for r in found.collect()) == closed

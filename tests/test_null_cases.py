"""Repeated days, NULL and negative needs, and aggregates without values."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from airloom import operators as ops


def test_repeated_days_cover_themselves(frame):
    df = frame([("2024-01-01", 1), ("2024-01-01", 2), ("2024-01-03", 3)], "t string, n int")
    df = df.select(F.to_date("t").alias("day"), "n")
    for first in (None, "2023-12-31"):
        found = ops.calendar_fill(df, "day", {"n": 0}, first=first, last="2024-01-04").collect()
        rows = sorted((r.day, r.n) for r in found)
        expected = [(date(2024, 1, 1), 1), (date(2024, 1, 1), 2), (date(2024, 1, 2), 0), (date(2024, 1, 3), 3), (date(2024, 1, 4), 0)]
        assert rows == ([(date(2023, 12, 31), 0)] if first else []) + expected


def test_needs_that_are_null_or_negative(frame):
    supply = frame([(1, 10), (1, 11)], "pool int, item_id int")
    demand = frame([(1, 1, 1, None), (1, 1, 2, 2), (1, 1, 3, -5), (1, 2, 4, 1), (1, 2, 5, 1)], "pool int, level int, key int, n int")
    rows = ops.shared_capacity_check(demand, supply, "pool", "level", "key").orderBy("key").collect()
    assert [(r.running_need, r.fits, r.overflows) for r in rows] == [
        (0, True, False), (2, True, False), (2, True, False), (3, False, True), (4, False, False),
    ]
    only = ops.capacity_check(frame([(1, None)], "pool int, n int"), supply, "pool").first()
    assert (only.needed, only.ok, only.short_by) == (0, True, 0)


def test_null_aggregates_stay_null(frame):
    entities = frame([(1,), (2,), (3,)], "k int")
    facts = frame([(1, None, "a"), (2, 5, "b")], "k int, v int, s string")
    rows = ops.entity_stats(entities, facts, "k", {"v": F.sum("v"), "s": F.max("s")}).orderBy("k").collect()
    assert [(r.v, r.s) for r in rows] == [(None, "a"), (5, "b"), (0, None)]


def test_a_kind_without_rows_can_be_filled(frame):
    df = frame([("2024-01-01 00:00:00", "a")], "ts timestamp_ntz, kind string")
    assert ops.trend_by_kind(df, "ts", "kind", ["a", "b"], F.count("ts"), fill=0).first()[1:] == (1, 0)

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from airloom import operators as ops
from tests.conftest import rows_of

EVENTS = "ts timestamp_ntz, event_type string"


@pytest.fixture
def trend(frame):
    return ops.conversion_trend(
        frame(
            [
                ("2024-01-01 00:00:00", "view"),
                ("2024-01-01 23:59:59.999999", "view"),
                ("2024-01-01 12:00:00", "purchase"),
                ("2024-01-04 12:00:00", "purchase"),  # no base that day
                ("2024-01-06 12:00:00", "view"),
                ("2024-01-05 12:00:00", "error"),
            ],
            EVENTS,
        ),
        "ts",
        "event_type",
        "view",
        "purchase",
    )


def test_rate_is_null_without_a_base(trend):
    assert rows_of(trend) == [
        (date(2024, 1, 1), 2, 1, 0.5),
        (date(2024, 1, 4), 0, 1, None),
        (date(2024, 1, 6), 1, 0, 0.0),
    ]


def test_calendar_fill_adds_days_and_keeps_nulls(trend):
    filled = ops.calendar_fill(trend, "day", {"base_events": 0, "conv_events": 0})
    assert rows_of(filled) == [
        (date(2024, 1, 1), 2, 1, 0.5),
        (date(2024, 1, 2), 0, 0, None),
        (date(2024, 1, 3), 0, 0, None),
        (date(2024, 1, 4), 0, 1, None),
        (date(2024, 1, 5), 0, 0, None),
        (date(2024, 1, 6), 1, 0, 0.0),
    ]


def test_calendar_fill_lines_series_up(frame):
    df = frame(
        [("a", "2024-01-02", 5), ("b", "2024-01-01", 7), (None, "2024-01-03", 1), ("c", None, 9)],
        "name string, day string, n bigint",
    ).withColumn("day", F.col("day").cast("date"))
    filled = ops.calendar_fill(df, "day", {"n": 0}, by=["name"])
    days = [date(2024, 1, d) for d in (1, 2, 3)]
    assert rows_of(filled) == [
        *zip("aaa", days, [0, 5, 0], strict=True),
        *zip("bbb", days, [7, 0, 0], strict=True),
        *zip([None] * 3, days, [0, 0, 1], strict=True),
    ]
    wide = ops.calendar_fill(df, "day", {"n": 0}, ["name"], "2023-12-31", "2024-01-02")
    assert rows_of(wide.where("name = 'b'")) == [
        ("b", date(2023, 12, 31), 0),
        ("b", date(2024, 1, 1), 7),
        ("b", date(2024, 1, 2), 0),
    ]
    assert ops.calendar_fill(df.where("false"), "day", {"n": 0}).collect() == []


def test_trend_by_kind_has_a_column_per_kind(frame):
    df = frame(
        [
            ("2024-01-01 01:00:00", "hook"),
            ("2024-01-01 02:00:00", "hook"),
            ("2024-01-02 02:00:00", "long"),
            ("2024-01-03 02:00:00", "other"),
        ],
        EVENTS,
    )
    result = ops.trend_by_kind(df, "ts", "event_type", ["hook", "long"], F.count(F.lit(1)))
    assert rows_of(result) == [(date(2024, 1, 1), 2, None), (date(2024, 1, 2), None, 1)]


def test_kpis_exact_and_approximate(frame):
    df = frame(
        [(1, "a", 5), (1, "b", None), (2, "a", 7), (None, "a", 1)],
        "user_id bigint, kind string, n bigint",
    )
    is_a = F.col("kind") == "a"
    metrics = {
        "all": ops.Metric("count"),
        "with_n": ops.Metric("count", "n"),
        "a": ops.Metric("count", when=is_a),
        "users": ops.Metric("distinct", "user_id"),
        "a_users": ops.Metric("distinct", "user_id", is_a),
        "total": ops.Metric("sum", "n"),
        "a_total": ops.Metric("sum", "n", is_a),
    }
    assert rows_of(ops.kpi_summary(df, metrics)) == [(4, 3, 3, 2, 2, 13, 13)]
    assert rows_of(ops.kpi_summary(df, metrics, approx=True)) == [(4, 3, 3, 2, 2, 13, 13)]
    nothing = ops.kpi_summary(df.where("false"), metrics)
    assert rows_of(nothing) == [(0, 0, 0, 0, 0, None, None)]
    two_columns = {**metrics, "kinds": ops.Metric("distinct", "kind")}
    assert rows_of(ops.kpi_summary(df, two_columns)) == [(4, 3, 3, 2, 2, 13, 13, 2)]
    for bad in (("median", "n"), ("sum", None)):
        with pytest.raises(ValueError):
            ops.Metric(*bad)


def test_entities_without_facts_get_zeros(frame):
    entities = frame([(1,), (2,)], "blogger_id bigint")
    facts = frame([(1, 2.5), (1, 1.5), (3, 9.0)], "blogger_id bigint, value double")
    stats = ops.entity_stats(
        entities,
        facts,
        "blogger_id",
        {"n": F.count("value"), "sum": F.sum("value"), "best": F.max("value")},
    )
    assert rows_of(stats) == [(1, 2, 4.0, 2.5), (2, 0, 0.0, 0.0)]

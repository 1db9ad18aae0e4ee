from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom import operators as ops
from tests.conftest import rows_of

SLOTS = "blogger_id bigint, dow int, start_h double, end_h double, enabled boolean"
INTERVALS = "key bigint, start_s double, end_s double"


def union(intervals):
    merged = []
    for start, end in sorted(i for i in intervals if i[0] < i[1]):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], end))
        else:
            merged.append((start, end))
    return merged


def test_merge_contained_touching_identical_and_empty(frame):
    df = frame(
        [
            (1, 0.0, 10.0),
            (1, 2.0, 3.0),
            (1, 10.0, 12.0),
            (1, 12.5, 13.0),
            (1, 12.5, 13.0),
            (1, 20.0, 20.0),
            (1, 30.0, 25.0),
            (2, 1.0, 2.0),
            (None, 1.0, 2.0),
        ],
        INTERVALS,
    )
    for width in (None, 1, 5.5, 1000):
        merged = ops.merge_intervals(df, "key", "start_s", "end_s", width)
        assert rows_of(merged) == [(1, 0.0, 12.0), (1, 12.5, 13.0), (2, 1.0, 2.0)]


@pytest.mark.parametrize("width", [None, 3, 10, 64])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_equals_brute_force(frame, width, seed):
    rng = random.Random(seed)
    rows = []
    for n in range(200):
        key = 0 if n % 3 == 0 else rng.randrange(1, 20)
        start = rng.randrange(-200, 800)
        length = rng.choice([0, 1, 2, 5, rng.randrange(1, 150)])
        rows.append((key, float(start), float(start + length)))
    merged = ops.merge_intervals(frame(rows, INTERVALS), "key", "start_s", "end_s", width)
    expected = [
        (key, *piece)
        for key in {row[0] for row in rows}
        for piece in union([row[1:] for row in rows if row[0] == key])
    ]
    assert sorted(map(tuple, merged.collect())) == sorted(expected)


@pytest.fixture
def slots(frame):
    return frame(
        [
            (1, 1, 9.0, 12.0, True),
            (1, 1, 11.0, 13.0, True),  # overlaps
            (1, 1, 13.0, 14.5, True),  # touches
            (1, 2, 9.0, 12.0, False),  # disabled
            (2, 7, 22.0, 2.0, True),  # past Sunday midnight
            (3, 3, 8.0, 8.0, True),  # all round the clock
            (5, 4, 8.0, 9.0, False),
        ],
        SLOTS,
    )


def test_weekly_intervals(slots):
    day = 1440
    assert rows_of(ops.weekly_intervals(slots, "blogger_id")) == sorted(
        [
            (1, 9 * 60, 14 * 60 + 30),
            (2, 0, 120),
            (2, 6 * day + 22 * 60, 7 * day),
            (3, 2 * day + 480, 3 * day + 480),
        ],
        key=lambda row: [(v is None, str(v)) for v in row],
    )


def test_schedule_summary(slots, frame):
    bloggers = frame([(n,) for n in (1, 2, 3, 4, 5)], "blogger_id bigint")
    assert rows_of(ops.schedule_summary(bloggers, slots)) == [
        (1, 1, 5.5, True),
        (2, 1, 4.0, True),
        (3, 1, 24.0, True),
        (4, 0, 0.0, False),
        (5, 0, 0.0, False),
    ]


def test_events_at_the_edges_of_slots(slots, frame):
    # 2024-01-01 is a Monday.
    cases = [
        (1, "2024-01-01 08:59:59.999999", False),
        (1, "2024-01-01 09:00:00", True),
        (1, "2024-01-01 11:30:00", True),  # in two slots: once in the result
        (1, "2024-01-01 14:29:59.999999", True),
        (1, "2024-01-01 14:30:00", False),
        (1, "2024-01-02 10:00:00", False),
        (2, "2024-01-07 23:59:59", True),
        (2, "2024-01-01 01:59:59", True),
        (2, "2024-01-01 02:00:00", False),
        (3, "2024-01-04 07:59:59", True),
        (4, "2024-01-01 10:00:00", False),
        (None, "2024-01-01 10:00:00", False),
        (1, None, False),
    ]
    events = frame(cases, "blogger_id bigint, ts timestamp_ntz, expected boolean")
    marked = ops.events_in_schedule(events, slots, "blogger_id", "ts")
    assert marked.count() == len(cases)
    assert marked.where(F.col("expected") != F.col("in_schedule")).collect() == []


@pytest.mark.parametrize("key", ["key", None])
@pytest.mark.parametrize("bucket", [None, 4, 50])
def test_overlap_equals_brute_force(frame, key, bucket):
    rng = random.Random(4)

    def side(base):
        rows = []
        for n in range(80):
            start = rng.randrange(-100, 200)
            length = rng.choice([0, 0.01, 0.25, 1, 4, 8, 64, rng.randrange(1, 90), 5000])
            rows.append((base + n, rng.randrange(0, 3), float(start), float(start + length)))
        return rows

    a, b = side(0), side(1000)
    ddl = "id bigint, key bigint, start_s double, end_s double"
    result = ops.timeline_overlap(frame(a, ddl), frame(b, ddl), key, bucket=bucket)
    expected = []
    for i, k1, s1, e1 in a:
        for j, k2, s2, e2 in b:
            if (key is None or k1 == k2) and max(s1, s2) < min(e1, e2):
                expected.append((i, j, max(s1, s2), min(e1, e2), min(e1, e2) - max(s1, s2)))
    columns = ["id_a", "id_b", "overlap_start", "overlap_end", "overlap"]
    assert sorted(map(tuple, result.select(columns).collect())) == sorted(expected)


def test_overlaps_read_each_side_twice(spark, tmp_path):
    """Once for the lengths in use, once for the pairs."""
    for name in "ab":
        spark.range(100).selectExpr("id % 3 AS source_id", "id", "id AS start_s", "id + 1 + id % 40 AS end_s").write.parquet(f"{tmp_path}/{name}")
    a, b = (spark.read.parquet(f"{tmp_path}/{name}") for name in "ab")
    pairs = ops.timeline_overlap(a, b, "source_id")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.index("== Initial Plan ==") :] if "== Initial Plan ==" in plan else plan
    for name in "ab":
        assert initial.count(f"{tmp_path}/{name}") <= 2, initial
    rows = [(r.source_id, r.id, r.start_s, r.end_s) for r in a.collect()]
    expected = sum(x[0] == y[0] and x[2] < y[3] and y[2] < x[3] for x in rows for y in rows)
    assert pairs.count() == pairs.select("id_a", "id_b").distinct().count() == expected


def test_starts_are_compared_with_few_intervals_in_vain(spark):
    """Fewer than half as many comparisons again as there are pairs, on both sides and all lengths."""
    sides = [
        spark.range(4000).selectExpr(
            f"id + {shift} * 10000 AS id", f"(id * 7919 + {shift} * 31) % 100000 AS start_s",
            "(id * 7919) % 100000 + 200 + (id * id) % 800 AS end_s",
        ).where("start_s < end_s")
        for shift in (0, 1)
    ]
    pairs = ops.timeline_overlap(*sides, None)
    joined = pairs._jdf.queryExecution().optimizedPlan()
    while not joined.nodeName() == "Join":
        joined = joined.children().head()
    inputs = [spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, child) for child in (joined.left(), joined.right())]
    left, right = (DataFrame(side, spark) for side in inputs)
    compared = left.join(right, ["_level", "_part", "_bucket"]).count()
    assert pairs.count() <= compared < 1.5 * pairs.count()

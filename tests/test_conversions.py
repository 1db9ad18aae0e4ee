from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from airloom.operators import conversions_within
from airloom.streaming import live_conversions
from tests.conftest import rows_of
from tests.test_streaming import collect, feed  # noqa: F401

DDL = "event_id bigint, ts timestamp_ntz, user_id bigint, status string"
START = datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else str(START + timedelta(seconds=seconds))


def data(seed, n, span=5000):
    rng = random.Random(seed)
    return [
        (i, rng.choice([None, *[rng.randrange(span) for _ in range(12)]]), rng.choice([1, 1, 1, 2, 3, None]), rng.choice("vp"))
        for i in range(n)
    ]


def plain(rows, within):
    return sorted(
        (v[2], v[0], p[0], float(p[1] - v[1]))
        for v in rows
        for p in rows
        if v[3] == "v" and p[3] == "p" and v[2] == p[2] is not None and None not in (v[1], p[1]) and 0 <= p[1] - v[1] <= within
    )


def framed(frame, rows):
    return frame([(i, at(t), u, s) for i, t, u, s in rows], DDL)


@pytest.mark.parametrize("within", [1, 60, 700, 10_000])
def test_equals_all_pairs(frame, within):
    rows = data(within, 400)
    rows += rows[:20]
    df = framed(frame, rows)
    found = conversions_within(df.where("status = 'v'"), df.where("status = 'p'"), "user_id", "ts", within)
    assert sorted(tuple(r) for r in found.select("user_id", "exposure_id", "conversion_id", "lag_s").collect()) == plain(rows, within)


def test_edges_and_wrong_bounds(frame):
    rows = [(1, 0, 1, "v"), (2, 60, 1, "p"), (3, 61, 1, "p"), (4, 0, 1, "p"), (5, 0, 2, "p")]
    df = framed(frame, rows)
    views, purchases = df.where("status = 'v'"), df.where("status = 'p'")
    found = conversions_within(views, purchases, "user_id", "ts", 60)
    assert rows_of(found.select("exposure_id", "conversion_id", "lag_s")) == [(1, 2, 60.0), (1, 4, 0.0)]
    assert conversions_within(views.limit(0), purchases, "user_id", "ts", 60).count() == 0
    with pytest.raises(ValueError):
        conversions_within(views, purchases, "user_id", "ts", 0)
    with pytest.raises(ValueError):
        conversions_within(views, purchases.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 60)


def test_a_hot_user_is_spread_over_stretches(frame):
    """The join is on user and stretch of time: no key of it has more than a stretch of rows."""
    from airloom.operators.conversions import meetings

    df = framed(frame, [(i, i * 5, 1, "v" if i % 2 else "p") for i in range(2000)])
    pairs = meetings(df.where("status = 'v'"), df.where("status = 'p'"), "user_id", "ts", 100, "event_id")
    widest = pairs.groupBy("_conversion_id_stretch").agg(F.count_distinct("conversion_id").alias("n")).agg(F.max("n")).first()[0]
    assert widest <= 20


def test_live_pairs_equal_batch_and_state_is_dropped(spark, frame, feed, tmp_path):  # noqa: F811
    rng = random.Random(7)
    rows = sorted((r for r in data(3, 600, 60_000) if r[1] is not None), key=lambda r: r[1] + rng.randrange(300))
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    batches += [[(9001, 90_000, 9, "v"), (9002, 90_000, 9, "p")], [(9003, 90_001, 9, "v"), (9004, 90_001, 9, "p")]]
    stream = feed(*([(i, at(t), u, s) for i, t, u, s in part] for part in batches))
    views, purchases = stream.where("status = 'v'"), stream.where("status = 'p'")
    pairs = live_conversions(views, purchases, "user_id", "ts", 500, "10 minutes")
    found = collect(spark, pairs, tmp_path)
    got = sorted(tuple(r) for r in found.select("user_id", "exposure_id", "conversion_id", "lag_s").collect())
    assert got == plain(rows + [x for part in batches[-2:] for x in part], 500)
    # A run over the same batches that shows the state at each: far fewer rows than have come in.
    query = pairs.writeStream.outputMode("append").format("noop").option("checkpointLocation", str(tmp_path / "again")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) < len(rows) / 2 and kept[-1] <= 12

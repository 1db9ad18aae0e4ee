from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from airloom.streaming import latest_status, live_counts, live_dedup, live_status, run_to_end, status_log
from tests.conftest import rows_of

DDL = "event_id bigint, ts timestamp_ntz, user_id bigint, status string"


@pytest.fixture
def feed(spark, frame, tmp_path):
    """Writes each list of rows as a file of its own and streams them one by one, in order."""

    def build(*batches):
        for number, rows in enumerate(batches):
            target = str(tmp_path / "in" / f"part-{number}")
            frame(rows, DDL).coalesce(1).write.parquet(target)
        return (
            spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").option("latestFirst", "false")
            .parquet(str(tmp_path / "in"))
        )

    return build


def collect(spark, stream, tmp_path):
    out = str(tmp_path / "out")
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", out)
    run_to_end(writer, str(tmp_path / "checkpoint"))
    return spark.read.schema(stream.schema).parquet(out)


def test_counts_leave_late_rows_and_open_windows_out(spark, feed, tmp_path):
    stream = feed(
        [
            (1, "2024-01-01 10:00:00", 1, "a"),
            (2, "2024-01-01 10:59:59", 1, "a"),
            (3, "2024-01-01 10:30:00", 1, "b"),
        ],
        [(4, "2024-01-01 13:00:00", 1, "a")],  # closes 10 to 11, with 30 minutes to spare
        [(5, "2024-01-01 12:45:00", 1, "a")],  # late, but its window is open
        [(6, "2024-01-01 10:15:00", 1, "a")],  # too late: its window has been given out
        [(7, "2024-01-01 15:00:00", 1, "a")],
    )
    counts = collect(spark, live_counts(stream, "ts", "1 hour", "30 minutes", ["status"]), tmp_path)
    found = counts.select(F.hour("window_start"), F.hour("window_end"), "status", "n")
    assert rows_of(found) == [
        (10, 11, "a", 2),
        (10, 11, "b", 1),
        (12, 13, "a", 1),
        (13, 14, "a", 1),
    ]


@pytest.mark.parametrize("salts", [1, 8])
def test_replays_are_dropped_within_the_watermark(spark, feed, tmp_path, salts):
    stream = feed(
        [(1, "2024-01-01 10:00:00", 1, "a"), (1, "2024-01-01 10:00:00", 1, "a")],
        [(1, "2024-01-01 10:00:00", 1, "a"), (2, "2024-01-01 10:01:00", 1, "b")],
        [(3, "2024-01-01 12:00:00", 1, "c")],
        [(3, "2024-01-01 12:00:00", 1, "c"), (4, "2024-01-01 12:00:01", 1, "d")],
        [(1, "2024-01-01 12:30:00", 1, "again")],  # long after: a new event of that id
    )
    once = collect(spark, live_dedup(stream, "event_id", "ts", "10 minutes", salts), tmp_path)
    assert rows_of(once.select("event_id", "status")) == [
        (1, "a"),
        (1, "again"),
        (2, "b"),
        (3, "c"),
        (4, "d"),
    ]


def test_many_copies_of_one_event_are_thinned_out(spark, feed, tmp_path):
    copies = [(1, "2024-01-01 10:00:00", 1, "a")] * 300
    others = [(n, "2024-01-01 10:00:00", 1, "b") for n in range(2, 100)]
    once = collect(spark, live_dedup(feed(copies + others, copies), "event_id", "ts", "1 hour"),
                   tmp_path)
    assert sorted(row.event_id for row in once.collect()) == list(range(1, 100))


def test_status_is_never_overwritten_by_an_older_one(spark, feed, tmp_path):
    stream = feed(
        [(1, "2024-01-01 10:00:00", 1, "a"), (2, "2024-01-01 11:00:00", 2, "x")],
        [(3, "2024-01-01 12:00:00", 1, "b")],
        [(4, "2024-01-01 11:00:00", 1, "late"), (5, "2024-01-01 11:00:00", 2, "tie")],
        [(6, None, 1, "no time"), (7, "2024-01-01 13:00:00", None, "nobody")],
    )
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    run_to_end(live_status(stream, "user_id", "ts", log), checkpoint)
    newest = latest_status(spark, log, "user_id").select("user_id", "event_id", "status")
    assert rows_of(newest) == [(1, 3, "b"), (2, 5, "tie")]
    # A second run from the same checkpoint finds nothing new.
    run_to_end(live_status(stream, "user_id", "ts", log), checkpoint)
    assert rows_of(latest_status(spark, log, "user_id").select("user_id", "status")) == [
        (1, "b"),
        (2, "tie"),
    ]


def test_status_takes_any_upsert_function(spark, feed, tmp_path):
    seen = {}

    def upsert(batch, epoch):
        seen.update({row.user_id: row.status for row in batch.collect()})

    stream = feed([(1, "2024-01-01 10:00:00", 1, "a")], [(2, "2024-01-01 11:00:00", 1, "b")])
    run_to_end(live_status(stream, "user_id", "ts", upsert), str(tmp_path / "checkpoint"))
    assert seen == {1: "b"}


def test_the_status_log_is_compacted_and_may_repeat_an_epoch(spark, tmp_path):
    log = str(tmp_path / "log")
    write = status_log(log, "user_id", block=2)
    kind = "user_id bigint, ts timestamp, event_id bigint, status string"
    for epoch in range(9):
        # User 100 changes in the first epoch only, user 1 in each.
        rows = [(1, datetime(2024, 1, 1, epoch), epoch, f"s{epoch}")]
        rows += [(100, datetime(2024, 1, 1), 50, "kept")] if epoch == 0 else []
        batch = spark.createDataFrame(rows, kind)
        for _ in range(2 if epoch in (3, 4, 6) else 1):
            write(batch, epoch)
        newest = latest_status(spark, log, "user_id").select("user_id", "status")
        assert rows_of(newest) == [(1, f"s{epoch}"), (100, "kept")]
    whole = spark.read.option("recursiveFileLookup", "true").parquet(log)
    assert whole.count() == 2 + 2 + 2 + 1  # two bases, the epochs of block 3 and epoch 8

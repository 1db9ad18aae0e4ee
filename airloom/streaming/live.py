"""Live counts, de-duplication and statuses over unbounded streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from airloom.functions.timing import as_event_time, as_local_time
from airloom.streaming.sinks import status_log


def live_counts(
    stream: DataFrame, ts: str, width: str, delay: str, by: Sequence[str]
) -> DataFrame:
    """Events per tumbling window and ``by``: ``(window_start, window_end, *by, n)``.

    For append mode: a window is given out once, when the watermark has passed its end. Events
    more than ``delay`` behind the newest one may be dropped. Counts are combined before the
    shuffle, and the state has a row per open window and ``by`` value.
    """
    counted = (
        stream.withColumn(ts, as_event_time(stream, ts))
        .withWatermark(ts, delay)
        .groupBy(F.window(ts, width), *by)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select(
        as_local_time(F.col("window.start")).alias("window_start"),
        as_local_time(F.col("window.end")).alias("window_end"),
        *by,
        "n",
    )


def live_dedup(stream: DataFrame, id: str, ts: str, delay: str, salts: int = 8) -> DataFrame:
    """Events without replays: an id is given out once while within ``delay`` of its first time.

    The state holds the ids of that stretch of time only. ``ts`` becomes an instant.

    Copies of one event all have the same id, and a shuffle by id would send them to one task.
    So they are thinned out in ``salts`` groups first and then once more by id. ``salts=1``
    skips that step, which saves a shuffle where replays are few.
    """
    events = stream.withColumn(ts, as_event_time(stream, ts)).withWatermark(ts, delay)
    if salts > 1:
        events = (
            events.withColumn("_salt", F.floor(F.rand(seed=1) * salts))
            .dropDuplicatesWithinWatermark([id, "_salt"])
            .drop("_salt")
        )
    return events.dropDuplicatesWithinWatermark([id])


def live_latest(
    stream: DataFrame, key: str, ts: str, status: str = "status", event_id: str = "event_id"
) -> DataFrame:
    """The newest status per key so far, for update mode: ``(key, ts, event_id, status)``.

    An event that arrives late never replaces a newer one. There is no watermark, as a status
    holds until the next one however long that takes: the state keeps a row per key for ever.
    """
    newest = F.max(F.struct(ts, event_id, F.col(status).alias("status")))
    return (
        stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
        .groupBy(key)
        .agg(newest.alias("_newest"))
        .select(key, "_newest.*")
    )


def live_status(
    stream: DataFrame,
    key: str,
    ts: str,
    sink: str | Callable[[DataFrame, int], None],
    status: str = "status",
    event_id: str = "event_id",
) -> DataStreamWriter:
    """A writer that keeps the newest status per key current in ``sink``.

    ``sink`` is a folder for :func:`status_log`, or a function that upserts the changed keys of
    a micro-batch by key. The caller sets checkpoint and trigger, and starts it.
    """
    # The batches call the newest status "status", whatever its column was called.
    upsert = status_log(sink, key, ts, event_id) if isinstance(sink, str) else sink
    changed = live_latest(stream, key, ts, status, event_id)
    return changed.writeStream.outputMode("update").foreachBatch(upsert)

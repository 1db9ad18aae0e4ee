"""Time expressions that give the same answer in every session time zone.

``timestamp_ntz`` columns are read as they stand; nothing here casts them to an instant
unless a stream needs it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_type(df: DataFrame, ts: str) -> str:
    """``timestamp`` or ``timestamp_ntz``; anything else is refused while planning."""
    kind = dict(df.dtypes).get(ts)
    if kind not in ("timestamp", "timestamp_ntz"):
        raise ValueError(f"{ts!r} must be a timestamp column, not {kind}")
    return kind


def time_literal(moment: str | datetime) -> Column:
    """A zone-free literal, comparable with ``timestamp_ntz`` columns."""
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from ``start`` to ``end``, exact to the microsecond."""
    return (end - start).cast("interval second").cast("decimal(20,6)")


def epoch_seconds(df: DataFrame, ts: str) -> Column:
    """Whole seconds since 1970 on the column's own clock, rounded down."""
    if time_type(df, ts) == "timestamp":
        return F.unix_seconds(ts)
    days = F.unix_date(F.to_date(ts)).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def time_slice(df: DataFrame, ts: str, minutes: int) -> Column:
    """Number of the fixed-width slice a time falls into; grows with time."""
    if minutes < 1:
        raise ValueError("a slice is at least one minute wide")
    return F.floor(epoch_seconds(df, ts) / F.lit(60 * minutes))


def week_second(ts: Column) -> Column:
    """Whole seconds since Monday 00:00, rounded down: 0 to 604799."""
    return F.weekday(ts) * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def as_event_time(df: DataFrame, ts: str) -> Column:
    """The column as an instant, reading zone-free times as UTC.

    Watermarks are refused on ``timestamp_ntz``. A plain cast would go through the session
    time zone and shift every window by its offset.
    """
    if time_type(df, ts) == "timestamp":
        return F.col(ts)
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(ts)).cast("timestamp")


def as_local_time(instant: Column) -> Column:
    """An instant as a zone-free UTC time: the way back from :func:`as_event_time`."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))

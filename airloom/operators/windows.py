"""Sliding windows put together from panes."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.functions.timing import epoch_seconds, time_type
from airloom.operators.slices import require

#: How the parts of panes become the value of a window.
MERGED = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def sliding_windows(
    events: DataFrame,
    ts: str,
    width_s: int,
    step_s: int,
    measures: Mapping[str, tuple[str, str | None]],
    by: Sequence[str] = (),
) -> DataFrame:
    """Measures over windows of ``width_s`` seconds, one every ``step_s``: ``(*by, window_start, window_end, *measures)``.

    Windows are half-open, start at multiples of the step since 1970, and are given if they hold an event.
    ``measures`` maps names to ``(how, column)``, where ``how`` is count, sum, min, max or avg, and a
    count without a column counts rows. Rows without a time are left out; NULL in ``by`` is a group.

    An event is in ``width/step`` windows, but is not copied: events are aggregated once by pane,
    the longest stretch that no window cuts, and windows are frames over the panes. What is
    ordered is a row per pane and group, and the gaps between them, not the events.
    """
    if step_s < 1 or width_s < 1:
        raise ValueError("width and step are at least a second")
    unknown = {how for how, _ in measures.values()} - {*MERGED, "avg"}
    if unknown:
        raise ValueError(f"unknown measure {sorted(unknown)}")
    pane_s = math.gcd(width_s, step_s)
    length = width_s // pane_s
    parts, merged = {}, {}
    frame = Window.partitionBy(*by).orderBy("_pane").rangeBetween(-(length - 1), 0)
    for name, (how, column) in measures.items():
        value = F.lit(1) if column is None else F.col(column)
        if how == "avg":
            parts |= {f"_sum_{name}": F.sum(value), f"_count_{name}": F.count(value)}
            total, n = (F.sum(f"_{part}_{name}").over(frame) for part in ("sum", "count"))
            merged[name] = F.try_divide(total, n)
        else:
            parts[f"_part_{name}"] = getattr(F, how)(value)
            merged[name] = MERGED[how](f"_part_{name}").over(frame)
    pane = F.floor(epoch_seconds(events, ts) / F.lit(pane_s))
    panes = (
        require(events, ts)
        .groupBy(*by, pane.alias("_own"))
        .agg(*(part.alias(name) for name, part in parts.items()))
    )
    # Each pane brings the empty ones along in which a window over it can still end.
    following = F.lead("_own").over(Window.partitionBy(*by).orderBy("_own"))
    until = F.least(F.coalesce(following, F.col("_own") + length) - 1, F.col("_own") + length - 1)
    filled = panes.withColumn("_until", until).select(
        *by, "_own", *parts, F.explode(F.sequence("_own", "_until")).alias("_pane")
    )
    own = F.col("_pane") == F.col("_own")
    filled = filled.withColumns({name: F.when(own, F.col(name)) for name in parts})
    start = (F.col("_pane") - (length - 1)) * pane_s
    counts = {name for name, (how, _) in measures.items() if how == "count"}
    found = filled.withColumns(merged).where(start % step_s == 0)
    return found.select(
        *by,
        _time(events, ts, start).alias("window_start"),
        _time(events, ts, start + width_s).alias("window_end"),
        *(F.coalesce(name, F.lit(0)).alias(name) if name in counts else name for name in measures),
    )


def _time(df: DataFrame, ts: str, seconds: Column) -> Column:
    if time_type(df, ts) == "timestamp":
        return F.timestamp_seconds(seconds)
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))

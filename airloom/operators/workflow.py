"""Production and review state."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.functions.timing import (
    seconds_between,
    time_literal,
    time_slice,
    time_type,
    week_second,
)
from airloom.operators.schedule import MINUTES_PER_WEEK, weekly_intervals
from airloom.operators.slices import (
    SLICE,
    earlier_slices,
    in_slices,
    join_carry,
    require,
    slice_order,
    slice_totals,
    within_slice,
)
from airloom.operators.skew import salted_join

SOON_SECONDS = 3600


def capacity_check(
    demand: DataFrame, supply: DataFrame, on: str, need: str = "n", item: str = "item_id"
) -> DataFrame:
    """Demand against distinct usable items per key: ``(on, needed, usable, ok, short_by)``.

    A NULL need is no need.
    """
    needed = demand.groupBy(on).agg(F.coalesce(F.sum(need), F.lit(0)).alias("needed"))
    usable = supply.groupBy(on).agg(F.count_distinct(item).alias("usable"))
    return (
        needed.join(usable, on, "left")
        .withColumn("usable", F.coalesce("usable", F.lit(0)))
        .withColumn("ok", F.col("usable") >= F.col("needed"))
        .withColumn("short_by", F.greatest(F.col("needed") - F.col("usable"), F.lit(0)))
    )


def shared_capacity_check(
    demand: DataFrame,
    supply: DataFrame,
    pool: str,
    priority: str,
    key: str,
    need: str = "n",
    item: str = "item_id",
    slice_width: int | None = None,
) -> DataFrame:
    """Demand served from shared pools, in order of priority and then key.

    Adds to ``demand`` the ``running_need`` of its pool up to and including the row, the
    ``usable`` items of the pool, ``fits``, and ``overflows`` on the first row that does not.

    A pool is summed in slices of about equally many rows, by a job that runs at once (see
    :func:`in_slices`). With ``slice_width``, the slices are that many keys of one level instead:
    ``key`` is then a whole number, and there is no job of its own. Rows lacking pool, priority or
    key are left out. A NULL need counts as 0, and so does a negative one: no target gives items
    back to its pool.
    """
    wanted = F.greatest(F.coalesce(F.col(need), F.lit(0)), F.lit(0))
    rows = require(demand, pool, priority, key)
    if slice_width is None:
        rows = in_slices(rows, [pool], [priority, key])
    else:
        # Level and key range together: their order is the order of the rows.
        key_range = F.floor(F.col(key) / F.lit(slice_width)).alias("range")
        rows = rows.withColumn(SLICE, F.struct(F.col(priority).alias("level"), key_range))
    inside = within_slice([pool], [priority, key]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # The pool's items go with the slices as well, so the rows are not shuffled by pool.
    usable = supply.groupBy(pool).agg(F.count_distinct(item).alias("usable"))
    carry = (
        slice_totals(rows, [pool], {"_need": F.sum(wanted)})
        .withColumn("_before", F.sum("_need").over(earlier_slices([pool])))
        .join(usable, pool, "left")
        .select(
            pool,
            SLICE,
            F.coalesce("_before", F.lit(0)).alias("_before"),
            F.coalesce("usable", F.lit(0)).alias("usable"),
        )
    )
    checked = (
        join_carry(rows.withColumn("_running", F.sum(wanted).over(inside)), carry, [pool])
        .withColumn("running_need", F.col("_before") + F.col("_running"))
        .withColumn("fits", F.col("running_need") <= F.col("usable"))
    )
    first = ~F.col("fits") & (F.col("running_need") - wanted <= F.col("usable"))
    return checked.withColumn("overflows", first).drop(SLICE, "_before", "_running")


def source_readiness(
    sources: DataFrame, items: DataFrame, on: str, ready: bool = True
) -> DataFrame:
    """Sources with (or, ``ready=False``, without) at least one usable item."""
    stocked = items.select(on).distinct()
    return sources.join(stocked, on, "left_semi" if ready else "left_anti")


def batch_progress(
    df: DataFrame, batch: str, ord: str, done: str, phase: str | None = None
) -> DataFrame:
    """Per batch the items done, all items, their ratio and the first unfinished item.

    With ``phase``, also the phase of that item; of several at the same place the first by
    name. A finished batch has neither. An item whose ``done`` is NULL is unfinished.
    """
    finished = F.coalesce(F.col(done), F.lit(False))
    fields = [F.col(ord).alias("item")]
    if phase is not None:
        fields.append(F.col(phase).alias("phase"))
    open_item = F.when(~finished, F.struct(*fields) if phase is not None else F.col(ord))
    progress = (
        df.groupBy(batch)
        .agg(
            F.count_if(finished).alias("done_items"),
            F.count(F.lit(1)).alias("total_items"),
            F.min(open_item).alias("_open"),
        )
        .withColumn("ratio", F.col("done_items") / F.col("total_items"))
    )
    if phase is None:
        return progress.withColumnRenamed("_open", "current_item")
    return progress.withColumns(
        {"current_item": F.col("_open.item"), "current_phase": F.col("_open.phase")}
    ).drop("_open")


def queue_position(
    df: DataFrame,
    queue: str,
    queued_at: str,
    key: str,
    done: str | None = None,
    slice_minutes: int | None = None,
) -> DataFrame:
    """First-in-first-out position of the unfinished items of each queue, ties by key.

    Rows without a queue or time are left out. A queue is numbered in slices of about equally many
    rows, by a job that runs at once (see :func:`in_slices`). With ``slice_minutes``, the slices
    are stretches of time instead, without that job: for queues without bursts.
    """
    waiting = require(df, queue, queued_at)
    if done is not None:
        waiting = waiting.where(~F.coalesce(F.col(done), F.lit(False)))
    time_type(df, queued_at)
    if slice_minutes is None:
        rows = in_slices(waiting, [queue], [queued_at, key])
    else:
        rows = waiting.withColumn(SLICE, time_slice(df, queued_at, slice_minutes))
    carry = slice_totals(rows, [queue], {"_n": F.count(F.lit(1))}).select(
        queue, SLICE, F.sum("_n").over(earlier_slices([queue])).alias("_before")
    )
    place = F.row_number().over(within_slice([queue], [queued_at, key]))
    return (
        join_carry(rows.withColumn("_place", place), carry, [queue])
        .withColumn("position", F.coalesce("_before", F.lit(0)) + F.col("_place"))
        .drop(SLICE, "_before", "_place")
    )


def current_status(
    events: DataFrame,
    key: str,
    ts: str,
    as_of: str | datetime,
    status: str = "status",
    event_id: str = "event_id",
    pending: Sequence[str] = ("pending",),
    slots: DataFrame | None = None,
) -> DataFrame:
    """The state of every key at ``as_of``: ``(key, status, since, state)``.

    ``status`` is that of the latest event up to then (by time, then id). With weekly slots,
    the state is ``running`` inside a slot, else ``soon`` if one starts within the hour; else,
    or without slots, ``review`` if the status is one of ``pending`` and ``ready`` otherwise.
    Keys known from their slots alone are listed with no status.
    """
    moment = _moment(events, ts, as_of)
    latest = (
        require(events, key)
        .where(F.col(ts) <= moment)
        .groupBy(key)
        .agg(
            F.max(
                F.struct(F.col(ts).alias("ts"), F.col(event_id).alias("id"), F.col(status).alias("s"))
            ).alias("_last")
        )
        .select(key, F.col("_last.s").alias("status"), F.col("_last.ts").alias("since"))
    )
    state = F.when(F.col("status").isin(*pending), "review").otherwise("ready")
    if slots is None:
        return latest.withColumn("state", state)
    # With the fraction of the second, for a slot that starts in exactly an hour.
    now = week_second(moment) + F.extract(F.lit("SECOND"), moment) - F.second(moment)
    start, end = F.col("start_m") * 60, F.col("end_m") * 60
    until = F.pmod(start - now, F.lit(MINUTES_PER_WEEK * 60))
    at_moment = (
        weekly_intervals(slots, key)
        .groupBy(key)
        .agg(
            F.max((start <= now) & (now < end)).alias("_inside"),
            F.max((until > 0) & (until <= SOON_SECONDS)).alias("_starting"),
        )
    )
    return latest.join(at_moment, key, "full").select(
        key,
        "status",
        "since",
        F.when(F.col("_inside"), "running")
        .when(F.col("_starting"), "soon")
        .otherwise(state)
        .alias("state"),
    )


def status_history(
    events: DataFrame,
    key: str,
    ts: str,
    status: str,
    event_id: str = "event_id",
    slice_minutes: int | None = None,
) -> DataFrame:
    """Every event with the status before it, the time of the next and the dwell in seconds.

    The open status of a key has no next time and no dwell. Rows without a key or time are left
    out. A key's events are ordered in slices of about equally many rows, by a job that runs at
    once (see :func:`in_slices`), or with ``slice_minutes`` in stretches of time without that job;
    the first and last row of each slice look across its edge.
    """
    time_type(events, ts)
    rows = require(events, key, ts)
    if slice_minutes is None:
        rows = in_slices(rows, [key], [ts, event_id])
    else:
        rows = rows.withColumn(SLICE, time_slice(events, ts, slice_minutes))
    order = slice_order([key])
    newest = F.max(F.struct(ts, event_id, F.col(status).alias("status")))
    carry = slice_totals(rows, [key], {"_first_ts": F.min(ts), "_newest": newest}).select(
        key,
        SLICE,
        F.lag("_newest.status").over(order).alias("_before"),
        F.lead("_first_ts").over(order).alias("_after"),
    )
    inside = within_slice([key], [ts, event_id])
    linked = rows.withColumns(
        {
            "_place": F.row_number().over(inside),
            "prev_status": F.lag(status).over(inside),
            "next_ts": F.lead(ts).over(inside),
        }
    )
    first = F.col("_place") == 1
    return (
        join_carry(linked, carry, [key])
        .withColumns(
            {
                "prev_status": F.when(first, F.col("_before")).otherwise(F.col("prev_status")),
                "next_ts": F.coalesce("next_ts", "_after"),
            }
        )
        .withColumn("dwell_s", seconds_between(F.col(ts), F.col("next_ts")).cast("double"))
        .drop(SLICE, "_place", "_before", "_after")
    )


def checklist_complete(
    checks: DataFrame,
    required: DataFrame,
    item: str,
    check: str = "check",
    only_complete: bool = False,
) -> DataFrame:
    """Per item the required checks ticked: ``(item, checked, required, complete)``.

    ``checks`` has a row per ticked check; repeated and unknown ones do not count.
    """
    wanted = required.select(check).distinct()
    # Few different checks share all the rows; repeated ones go before they are shuffled by check.
    marked = salted_join(
        checks.select(item, check).distinct(), wanted.withColumn("_wanted", F.lit(True)), check, [item], "left"
    )
    ticked = (
        marked.groupBy(item)
        .agg(F.count_distinct(F.when(F.col("_wanted"), F.col(check))).alias("checked"))
        .withColumn("required", wanted.agg(F.count(F.lit(1))).scalar())
        .withColumn("complete", F.col("checked") == F.col("required"))
    )
    return ticked.where("complete") if only_complete else ticked


def return_reasons(df: DataFrame, item: str, reasons: str) -> DataFrame:
    """How many returned items name each reason, and their share of all returned items.

    An item may name several, so the shares can add up to more than 1. Items that came back
    without any reason count in the base.
    """
    kind = df.schema[reasons].dataType
    # NULL stands for having come back at all, so that one pass counts the base as well.
    given = F.filter(F.coalesce(reasons, F.array().cast(kind)), lambda reason: reason.isNotNull())
    marked = F.concat(F.array(F.lit(None)).cast(kind), given)
    counts = (
        df.select(item, F.explode(marked).alias("reason"))
        .groupBy("reason")
        .agg(F.count_distinct(item).alias("items"), F.max(F.col("reason").isNotNull()).alias("_named"))
    )
    # Both sides tell the base by an aggregate, which no filter is pushed below: the aggregation is
    # the same, and its exchange is used again.
    returned = counts.agg(F.max(F.when(~F.col("_named"), F.col("items")))).scalar()
    return counts.where("_named").withColumn("share", F.col("items") / returned).drop("_named")


def content_profile(
    items: DataFrame,
    scores: DataFrame,
    on: str,
    length: str,
    edges: Sequence[float],
    score: str = "score",
    median: bool = False,
) -> DataFrame:
    """Items, scored items, mean score and coverage per length bucket.

    ``edges`` cut the lengths into half-open buckets: bucket 0 is below the first edge, bucket
    i starts at edge i. Scores are unique per item. ``median`` adds an approximate median.
    """
    if list(edges) != sorted(set(edges)):
        raise ValueError("edges must increase")
    bucket = F.when(F.col(length).isNotNull(), F.lit(0))
    for number, edge in enumerate(edges, 1):
        bucket = F.when(F.col(length) >= edge, number).otherwise(bucket)
    scored = items.select(on, bucket.alias("bucket")).join(scores.select(on, score), on, "left")
    measures = [
        F.count(F.lit(1)).alias("items"),
        F.count(score).alias("scored"),
        F.avg(score).alias("mean_score"),
    ]
    if median:
        measures.append(F.percentile_approx(score, 0.5).alias("median_score"))
    profile = scored.groupBy("bucket").agg(*measures)
    return profile.withColumn("coverage", F.col("scored") / F.col("items"))


def new_entities(df: DataFrame, key: str, ts: str, as_of: str | datetime, days: int) -> DataFrame:
    """First sighting of every key seen by ``as_of``, and whether it is at most ``days`` old."""
    moment = _moment(df, ts, as_of)
    since = moment - F.make_dt_interval(F.lit(days))
    return (
        require(df, key)
        .where(F.col(ts) <= moment)
        .groupBy(key)
        .agg(F.min(ts).alias("first_seen"))
        .withColumn("is_new", F.col("first_seen") > since)
    )


def _moment(df: DataFrame, ts: str, as_of: str | datetime) -> Column:
    moment = time_literal(as_of)
    return moment.cast("timestamp") if time_type(df, ts) == "timestamp" else moment

"""Ordered conversion funnels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.functions.timing import time_slice
from airloom.operators.slices import SLICE, require


def funnel_reach(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    kind: str,
    stages: Sequence[str],
    slice_minutes: int = 5,
) -> DataFrame:
    """How many stages each subject reached: ``(*keys, reached)``, 0 if only later ones.

    A subject's time line is cut into slices, so that a busy subject is shared out. For every
    stage a subject may have when a slice begins, the windows inside the slice find the stage
    it has when the slice ends; walking these transitions slice by slice gives the result.
    The walk sees one row per active slice, 288 at most for a subject of one day.

    Rows without a key or a time are left out.
    """
    _check_stages(stages)
    n = len(stages)
    number = F.lit(None).cast("int")
    for position, stage in enumerate(stages, 1):
        number = F.when(F.col(kind) == stage, position).otherwise(number)
    events = (
        require(df.where(F.col(kind).isin(*stages)), *keys, ts)
        .select(
            *keys,
            number.alias("_stage"),
            F.col(ts).alias("_ts"),
            time_slice(df, ts, slice_minutes).alias(SLICE),
        )
        .repartition(*keys, SLICE)  # before the stage times are added, to shuffle less
    )

    # _t{i}_{j}: the time stage j is reached in this slice by a subject that enters with i.
    inside = Window.partitionBy(*keys, SLICE)
    for step in range(1, n + 1):
        times = {}
        for entered in range(n - step + 1):
            target = entered + step
            hit = F.col("_stage") == target
            if step > 1:
                hit = hit & (F.col("_ts") > F.col(f"_t{entered}_{target - 1}"))
            times[f"_t{entered}_{target}"] = F.min(F.when(hit, F.col("_ts"))).over(inside)
        events = events.withColumns(times)

    # _to{i}: the stage a subject that enters the slice with i leaves it with.
    leaves = {
        f"_to{entered}": F.lit(entered)
        + sum(
            (F.col(f"_t{entered}_{target}").isNotNull().cast("int")
             for target in range(entered + 1, n + 1)),
            F.lit(0),
        )
        for entered in range(n)
    }
    slices = (
        events.withColumns(leaves)
        .groupBy(*keys, SLICE)
        .agg(*(F.max(name).alias(name) for name in leaves))
    )

    # Each step jumps to the first later slice that moves the subject on, at most n times.
    def state(since: Column, at: Column) -> Column:
        return F.struct(since.cast("bigint").alias("since"), at.cast("int").alias("at"))

    subject = Window.partitionBy(*keys)
    walk = slices.withColumn("_state", state(F.lit(None), F.lit(0)))
    since, at = F.col("_state.since"), F.col("_state.at")
    leaving = _pick([f"_to{i}" for i in range(n)], at)
    moves = (since.isNull() | (F.col(SLICE) > since)) & (leaving > at)
    jump = F.min(F.when(moves, state(F.col(SLICE), leaving))).over(subject)
    for _ in range(n):
        walk = walk.withColumn("_state", F.coalesce(jump, F.col("_state")))
    return walk.groupBy(*keys).agg(F.max("_state.at").alias("reached"))


def ordered_funnel(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    kind: str,
    stages: Sequence[str],
    slice_minutes: int = 5,
) -> DataFrame:
    """Subjects per stage: ``(stage, event_type, subjects)``.

    A subject reaches stage i with an event of type i strictly after the earliest time it
    reached stage i-1. Stages nobody reached are listed with 0.
    """
    reach = funnel_reach(df, keys, ts, kind, stages, slice_minutes)
    return _stage_rows(reach.agg(*_stage_counts(stages)), [], stages)


def funnel_split(
    df: DataFrame,
    dim: DataFrame,
    on: str,
    by: str,
    keys: Sequence[str],
    ts: str,
    kind: str,
    stages: Sequence[str],
    slice_minutes: int = 5,
) -> DataFrame:
    """The funnel and its transitions for every value of ``dim[by]``.

    ``on`` is one of ``keys`` and unique in ``dim``. The attribute is joined to the finished
    subjects, not to their events; subjects without one are counted under NULL.
    """
    if on not in keys:
        raise ValueError(f"{on!r} must be one of the subject keys {list(keys)}")
    reach = funnel_reach(df, keys, ts, kind, stages, slice_minutes)
    split = reach.join(dim.select(on, by), on, "left")
    counts = split.groupBy(by).agg(*_stage_counts(stages))
    return funnel_transitions(_stage_rows(counts, [by], stages), [by])


def funnel_transitions(funnel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rates and losses between the stages of :func:`ordered_funnel`.

    Adds ``prev_subjects``, ``step_rate`` (of the previous stage), ``overall_rate`` (of the
    first stage) and ``drop_off``; a rate with nobody in its base is NULL. One window group is
    one funnel, that is, a row per stage.
    """
    steps = Window.partitionBy(*by).orderBy("stage")
    return funnel.select(
        *by,
        "stage",
        "event_type",
        "subjects",
        F.lag("subjects").over(steps).alias("prev_subjects"),
        F.first("subjects").over(steps).alias("_base"),
    ).select(
        *by,
        "stage",
        "event_type",
        "subjects",
        "prev_subjects",
        F.try_divide("subjects", "prev_subjects").alias("step_rate"),
        F.try_divide("subjects", "_base").alias("overall_rate"),
        (F.col("prev_subjects") - F.col("subjects")).alias("drop_off"),
    )


def _check_stages(stages: Sequence[str]) -> None:
    if not stages or len(set(stages)) != len(stages):
        raise ValueError("a funnel needs one or more different stages")


def _pick(names: Sequence[str], index: Column) -> Column:
    picked = F.when(index == 0, F.col(names[0]))
    for number, name in enumerate(names[1:], 1):
        picked = picked.when(index == number, F.col(name))
    return picked


def _stage_counts(stages: Sequence[str]) -> list[Column]:
    return [
        F.count_if(F.col("reached") >= number).alias(f"_stage{number}")
        for number in range(1, len(stages) + 1)
    ]


def _stage_rows(counts: DataFrame, by: Sequence[str], stages: Sequence[str]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(number).alias("stage"),
            F.lit(stage).alias("event_type"),
            F.col(f"_stage{number}").alias("subjects"),
        )
        for number, stage in enumerate(stages, 1)
    ]
    return counts.select(*by, F.inline(F.array(*rows)))

"""Key figures, daily trends and per-creator statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


@dataclass(frozen=True)
class Metric:
    """One key figure: ``count``, ``distinct`` or ``sum`` of ``column``, where ``when`` holds.

    A count without a column counts rows.
    """

    how: str
    column: str | None = None
    when: Column | None = None

    def __post_init__(self) -> None:
        if self.how not in ("count", "distinct", "sum"):
            raise ValueError(f"unknown metric {self.how!r}; use count, distinct or sum")
        if self.column is None and self.how != "count":
            raise ValueError(f"metric {self.how!r} needs a column")

    def value(self) -> Column:
        value = F.lit(1) if self.column is None else F.col(self.column)
        return value if self.when is None else F.when(self.when, value)

    def whole(self, approx: bool) -> Column:
        """Over all rows at once."""
        if self.how == "distinct":
            count = F.approx_count_distinct if approx else F.count_distinct
            return count(self.value())
        return (F.sum if self.how == "sum" else F.count)(self.value())

    def of_value(self) -> Column:
        """Over the rows of one distinct value: whether it counts, or the part it adds."""
        if self.how == "distinct":
            return F.count(self.value()) > 0
        return self.whole(approx=False)

    def of_parts(self, part: str) -> Column:
        """Over the distinct values, from :meth:`of_value`."""
        if self.how == "distinct":
            return F.count_if(part)
        total = F.sum(part)
        return total if self.how == "sum" else F.coalesce(total, F.lit(0))


def kpi_summary(df: DataFrame, metrics: Mapping[str, Metric], approx: bool = False) -> DataFrame:
    """All key figures in one row.

    Distinct counts that share a column, with different conditions or not, are taken from one
    aggregation by that column; Spark would otherwise copy every row for each of them.
    ``approx`` replaces them by sketches of fixed size and saves their shuffle.
    """
    columns = {metric.column for metric in metrics.values() if metric.how == "distinct"}
    if approx or len(columns) != 1:
        return df.agg(*(m.whole(approx).alias(name) for name, m in metrics.items()))
    parts = df.groupBy(*columns).agg(
        *(metric.of_value().alias(f"_{name}") for name, metric in metrics.items())
    )
    return parts.agg(*(m.of_parts(f"_{name}").alias(name) for name, m in metrics.items()))


def conversion_trend(df: DataFrame, ts: str, kind: str, base: str, conv: str) -> DataFrame:
    """Per day the base and the converting events and their rate, NULL without a base."""
    daily = (
        df.where(F.col(kind).isin(base, conv))
        .groupBy(F.to_date(ts).alias("day"))
        .agg(
            F.count_if(F.col(kind) == base).alias("base_events"),
            F.count_if(F.col(kind) == conv).alias("conv_events"),
        )
    )
    return daily.withColumn("rate", F.try_divide("conv_events", "base_events"))


def calendar_fill(
    df: DataFrame,
    day: str,
    fill: Mapping[str, object],
    by: Sequence[str] | None = None,
    first: str | None = None,
    last: str | None = None,
) -> DataFrame:
    """Add the missing days, with the values in ``fill``.

    Rows that repeat a day of a series are all kept, and the gap follows the last; columns not in ``fill`` are NULL on added days.
    Each series named by ``by`` gets every day from ``first`` to ``last``, so that series line
    up. Without these the range of all days is taken, which needs a pass over ``df`` of its
    own. Rows outside the range or without a day are left out.

    Each row brings along the gap up to the next one, so there is no calendar to join. The
    window groups have a row per day.
    """
    series = list(by or [])
    dated = df.where(F.col(day).isNotNull())
    if first is not None:
        dated = dated.where(F.col(day) >= F.lit(first).cast("date"))
    if last is not None:
        dated = dated.where(F.col(day) <= F.lit(last).cast("date"))
    if first is None or last is None:
        range_ = dated.agg(F.struct(F.min(day).alias("first"), F.max(day).alias("last"))).scalar()
        dated = dated.withColumn("_range", range_)
    start = F.col("_range.first") if first is None else F.lit(first).cast("date")
    end = F.col("_range.last") if last is None else F.lit(last).cast("date")

    order = Window.partitionBy(*series).orderBy(day)
    spans = dated.withColumns(
        {
            "_from": F.when(F.lag(day).over(order).isNull(), start).otherwise(F.col(day)),
            # A day that is there twice covers itself both times.
            "_until": F.greatest(F.coalesce(F.date_sub(F.lead(day).over(order), 1), end), day),
        }
    )
    days = spans.withColumn("_day", F.explode(F.sequence("_from", "_until")))
    added = F.col("_day") != F.col(day)
    columns = []
    for name in df.columns:
        if name == day:
            columns.append(F.col("_day").alias(day))
        elif name in series:
            columns.append(F.col(name))
        else:
            value = F.lit(fill.get(name))
            columns.append(F.when(added, value).otherwise(F.col(name)).alias(name))
    return days.select(*columns)


def trend_by_kind(
    df: DataFrame,
    ts: str,
    kind: str,
    kinds: Sequence[str],
    agg: Column,
    fill: int | float | None = None,
) -> DataFrame:
    """Per day one column for each of ``kinds``; ``fill`` stands for a kind that the day lacks.

    The kinds are named by the caller: Spark would otherwise run a job to find them.
    """
    daily = (
        df.where(F.col(kind).isin(*kinds))
        .groupBy(F.to_date(ts).alias("day"))
        .pivot(kind, list(kinds))
        .agg(agg)
    )
    return daily if fill is None else daily.fillna(fill, subset=list(kinds))


def entity_stats(
    entities: DataFrame,
    facts: DataFrame,
    on: str,
    aggs: Mapping[str, Column],
) -> DataFrame:
    """Aggregates per entity; entities without facts are kept with zeros.

    An aggregate that is NULL over an entity's facts stays NULL, and so does a text without facts.
    Facts are aggregated before the join, so one row per entity meets one row per entity.
    """
    totals = facts.groupBy(on).agg(*(column.alias(name) for name, column in aggs.items()))
    numbers = [f.name for f in totals.schema if f.name in aggs and isinstance(f.dataType, NumericType)]
    joined = entities.join(totals.withColumn("_facts", F.lit(True)), on, "left")
    return joined.withColumns(
        {name: F.when(F.col("_facts").isNull(), 0).otherwise(F.col(name)) for name in numbers}
    ).drop("_facts")

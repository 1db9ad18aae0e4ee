"""Rankings, drilldown and topic choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOPIC_CHOICES = (1, 2, 3)

# How a measure of a child is combined into the measure of its parent.
_COMBINE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def effect_ranking(df: DataFrame, key: str, metric: Column, n: int) -> DataFrame:
    """The ``n`` best keys by an aggregate: ``(rank, key, metric)``; ties by key.

    Keys without a value come last. Every task keeps ``n`` rows, so the numbering at the
    end sees ``n`` rows too.
    """
    if n < 1:
        raise ValueError("a ranking has at least one row")
    order = [F.col("metric").desc_nulls_last(), F.col(key).asc()]
    best = df.groupBy(key).agg(metric.alias("metric")).orderBy(*order).limit(n)
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), key, "metric")


def ranking_by_group(
    df: DataFrame, group: Sequence[str] | str, order_by: Sequence[str | Column], n: int
) -> DataFrame:
    """The first ``n`` rows of every group, numbered in ``rank``.

    ``order_by`` should be a total order. Spark cuts the groups to ``n`` rows in every task
    before the shuffle, so a group of any size arrives as ``n`` rows per task.
    """
    if n < 1:
        raise ValueError("a ranking has at least one row")
    groups = [group] if isinstance(group, str) else list(group)
    ranked = df.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order_by))
    )
    return ranked.where(F.col("rank") <= n)


def topic_suggestions(
    candidates: DataFrame, by: Sequence[str], topic: str, score: str, k: int
) -> DataFrame:
    """The ``k`` best-scored candidate topics of every ``by`` group, k being 1, 2 or 3.

    A topic offered more than once counts once, with its best score; ties go by topic.
    """
    if k not in TOPIC_CHOICES:
        raise ValueError(f"k must be one of {TOPIC_CHOICES}, not {k!r}")
    best = candidates.groupBy(*by, topic).agg(F.max(score).alias(score))
    return ranking_by_group(best, by, [F.col(score).desc_nulls_last(), F.col(topic).asc()], k)


def drilldown(
    df: DataFrame, parent: str, child: str, aggs: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Totals per parent and per child in one result, told apart by ``level``.

    ``aggs`` maps a name to ``(function, column)`` with sum, count, min, max or avg. These combine
    (an average as sum and count), so the rows are aggregated and shuffled once, by child, and the
    parents are made of that result: a rollup of the rows would shuffle a second copy of them.
    """
    parts: dict[str, tuple[str, str]] = {}
    results = [F.col("level"), F.col(parent), F.col(child)]
    for name, (how, column) in aggs.items():
        if how == "avg":
            total, number = f"_total_{name}", f"_number_{name}"
            parts |= {total: ("sum", column), number: ("count", column)}
            results.append(F.try_divide(total, number).alias(name))
        elif how in _COMBINE:
            parts[name] = (how, column)
            results.append(F.col(name))
        else:
            raise ValueError(f"cannot combine {how!r}; use avg or one of {sorted(_COMBINE)}")
    children = df.groupBy(parent, child).agg(
        *(getattr(F, how)(column).alias(name) for name, (how, column) in parts.items())
    )
    parents = children.groupBy(parent).agg(
        *(_COMBINE[how](name).alias(name) for name, (how, _) in parts.items())
    )
    return (
        parents.withColumns({"level": F.lit(parent), child: F.lit(None)})
        .unionByName(children.withColumn("level", F.lit(child)))
        .select(results)
    )

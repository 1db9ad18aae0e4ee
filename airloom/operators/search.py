"""Catalogue search, facets and pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search_filter(
    df: DataFrame,
    text: str,
    text_cols: Sequence[str],
    equals: Mapping[str, object] | None = None,
) -> DataFrame:
    """Rows with ``text`` in any of ``text_cols`` and the chosen value in every facet.

    The text is taken literally and without regard to case; an empty one filters nothing.
    A facet whose value is None is not chosen. The facet equalities reach the scan.
    """
    found = df
    for name, value in (equals or {}).items():
        if value is not None:
            found = found.where(F.col(name) == value)
    if text:
        if not text_cols:
            raise ValueError("a text search needs at least one text column")
        needle = F.lower(F.lit(text))
        hit = F.lit(False)
        for name in text_cols:
            hit = hit | F.coalesce(F.lower(F.col(name)).contains(needle), F.lit(False))
        found = found.where(hit)
    return found


def catalog_page(
    df: DataFrame, order_by: Sequence[str | Column], n: int, total: str = "total_matches"
) -> DataFrame:
    """The first ``n`` rows, each with the number of all matches.

    ``order_by`` has to be a total order. The count is a one-row subquery, so the rows
    themselves are only ever cut to ``n`` per task, never gathered.
    """
    if n < 1:
        raise ValueError("a page has at least one row")
    matches = df.agg(F.count(F.lit(1)))
    return df.orderBy(*order_by).limit(n).withColumn(total, matches.scalar())


def facet_counts(df: DataFrame, facets: Sequence[str]) -> DataFrame:
    """Every value of every facet with its count: ``(facet, value, n)``, values as text.

    One pass over the data: the grouping sets are counted together, and before the shuffle.
    """
    if not facets:
        raise ValueError("name at least one facet")
    columns = [F.col(name) for name in facets]
    counted = df.groupingSets([[column] for column in columns], *columns).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.grouping(name).alias(f"_grouping_{name}") for name in facets),
    )
    facet, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in facets:
        active = F.col(f"_grouping_{name}") == 0
        facet = F.when(active, F.lit(name)).otherwise(facet)
        value = F.when(active, F.col(name).cast("string")).otherwise(value)
    return counted.select(facet.alias("facet"), value.alias("value"), "n")


def status_tab_counts(df: DataFrame, status: str, all_label: str = "all") -> DataFrame:
    """Count per status and one row for all: ``(tab, status, n)``.

    ``tab`` is ``all`` for the total and ``status`` elsewhere, so that rows without a status
    are not taken for the total.
    """
    # Counted per status first, so that only these few rows are rolled up.
    counts = df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    tabs = counts.rollup(status).agg(F.sum("n").alias("n"), F.grouping(status).alias("_total"))
    return tabs.select(
        F.when(F.col("_total") == 1, F.lit(all_label)).otherwise(F.lit("status")).alias("tab"),
        status,
        F.coalesce("n", F.lit(0)).alias("n"),
    )

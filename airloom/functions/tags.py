"""Tag-set expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_set(tags: Column) -> Column:
    """Distinct tags in order, without NULL; a NULL array counts as no tags."""
    cleaned = F.filter(F.array_distinct(tags), lambda tag: tag.isNotNull())
    return F.sort_array(F.coalesce(cleaned, F.array().cast("array<string>")))

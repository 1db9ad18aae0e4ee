"""Helpers shared by the operators on content scripts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.session import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"
HASH_BITS = 60


def written(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe from lost executors.

    A join then sees the true size of a small table, so that Spark's own size check decides
    whether it is broadcast, and both sides of a shuffled join can be split where they are skewed.
    """
    folder = shared_folder(df.sparkSession, purpose)
    df.write.options(**options).parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table._written_to = folder
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` as soon as nothing that is still to run reads them.

    What was made of them must have been written itself, so that nothing is ever computed from them again.
    """
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words_of(text: Column) -> Column:
    """The words between ASCII white space, as an array; NULL text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda word: word != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hash_key(*parts: Column | str | int) -> Column:
    """A uniform number below 2**60 from the parts' text; the same in any engine with MD5."""
    columns = [part if isinstance(part, Column) else F.lit(str(part)) for part in parts]
    text = F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def slice_of(key: Column, slices: Column) -> Column:
    """Which of ``slices`` equal ranges of the hash a key falls into (fewer than 2**30 slices)."""
    half = HASH_BITS // 2
    return F.shiftright(F.shiftright(key, half) * slices, half)


def root_of(rows: Column) -> Column:
    """So many slices that neither their number nor their length exceeds the root of the rows."""
    return F.ceil(F.sqrt(rows.cast("double"))).cast("bigint")


def rewritten(content: DataFrame, found: DataFrame, content_id: str, script: str, text: Column) -> DataFrame:
    """``content`` with the scripts replaced by ``text``, a column over ``_script`` and ``found``.

    ``found`` has a row per ``_id`` at most. The columns of ``content`` may have any names.
    """
    whole = F.struct(*(F.col(f"`{name}`") for name in content.columns)).alias("_row")
    rows = content.select(whole, F.col(f"`{content_id}`").alias("_key"), F.col(f"`{script}`").alias("_script"))
    joined = rows.join(found, F.col("_key") == F.col("_id"), "left")
    kept = (text if name == script else F.col(f"_row.`{name}`") for name in content.columns)
    return joined.select(*(column.alias(name) for column, name in zip(kept, content.columns, strict=True)))


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()

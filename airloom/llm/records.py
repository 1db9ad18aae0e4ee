"""The driver's tables seen as content scripts, source excerpts and review results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.llm.common import let, words_of
from airloom.sources import load_table


def as_scripts(documents: DataFrame) -> DataFrame:
    """Documents as content items: the text is the script, the source the blogger."""
    return documents.select(
        F.col("doc_id").alias("content_id"),
        F.col("text").alias("script"),
        F.col("lang").alias("language"),
        F.col("source").alias("blogger"),
    )


def scripts(spark: SparkSession, folder: str) -> DataFrame:
    return as_scripts(load_table(spark, folder, "documents"))


def excerpts(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items as source excerpts that must not leak into scripts."""
    return load_table(spark, folder, "benchmark").select(
        F.col("item_id").alias("source_id"), F.col("text").alias("excerpt")
    )


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Quality labels as review results: 1 for a passed script."""
    return load_table(spark, folder, "labels").select(
        F.col("doc_id").alias("content_id"), F.col("quality").alias("passed")
    )


def fold_of(content_id: Column, folds: int) -> Column:
    """The fold of a content item, by the checksum of its id as text."""
    return F.crc32(content_id.cast("string")) % folds


def featured(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as catalogue items with their features."""
    return load_table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("features")
    )


def looped(content: DataFrame) -> DataFrame:
    """Scripts, of which a tenth by id go round in a loop from some word on.

    With the checksum ``h`` of the id and ``g = h div 10``, that is where ``h`` ends in 0: from word
    ``a = g mod n`` of ``n`` words on, the ``1 + (n - a) div (3 + g mod 8)`` words there are repeated.
    Other scripts, and those without id, stay as they are.
    """
    checksum = F.crc32(F.col("content_id").cast("string"))
    g = F.floor(checksum / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        start = g % n
        period = 1 + F.floor((n - start) / (3 + g % 8))
        return F.array_join(
            F.transform(
                words,
                lambda word, place: F.when(place < start, word).otherwise(
                    F.get(words, (start + (place - start) % period).cast("int"))
                ),
            ),
            " ",
        )

    chosen = (checksum % 10 == 0) & F.col("script").rlike(r"[^\x20\x09-\x0D]")
    script = F.when(chosen, let(words_of(F.col("script")), planted)).otherwise(F.col("script"))
    return content.withColumn("script", script)

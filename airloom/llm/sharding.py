"""Shards that all have the mixture of the whole (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airloom.llm.common import hash_key, root_of, slice_of, written


def stratified_shards(
    content: DataFrame,
    shards: int = 8,
    seed: str = "shards",
    content_id: str = "content_id",
    script: str = "script",
    blogger: str = "blogger",
) -> DataFrame:
    """Deal content items out to shards so that each has every blogger's share of the whole.

    The items of a blogger are ranked in a seeded random order. All items are then sorted by
    their fractional rank, (rank - 1/2) / items of the blogger, and the sorted row is cut into
    ``shards`` pieces whose lengths differ by one at most. At either cut of a shard, a blogger with
    the share p of all items is off by at most half an item, and by another half of p for each
    other blogger's rounding.

    ``(content_id, blogger, size, script_crc32, shard, slot)``: size is the UTF-8 length of the
    script plus 1, ``slot`` the place in the shard from 0. Scripts are hashed where they are read
    and not shuffled; join them by id. One row per row of ``content``: NULL scripts have size 1,
    NULL bloggers are a stratum of their own, and items with equal id and script, which nothing
    tells apart, take neighbouring ranks. Other columns of ``content`` are left out.

    Both sorts are cut into slices of about the root of their rows, so that no task orders a
    whole blogger or the whole corpus.
    """
    text = F.coalesce(F.col(script), F.lit(""))
    stratum = F.coalesce(F.concat(F.lit("="), F.col(blogger).cast("string")), F.lit(""))
    items = written(
        content.select(
            F.col(content_id).alias("content_id"),
            F.col(blogger).alias("blogger"),
            stratum.alias("stratum"),
            (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
            F.crc32(text).alias("script_crc32"),
            hash_key(seed, F.col(content_id), F.md5(text)).alias("key"),
        ),
        "shard-items",
    )
    sizes = written(
        items.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")), "shard-strata"
    )
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sliced = items.join(sizes, "stratum").withColumn(
        "slice", slice_of(F.col("key"), root_of(F.col("n")))
    )
    before = Window.partitionBy("stratum").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = written(
        sliced.groupBy("stratum", "slice")
        .agg(F.count(F.lit(1)).alias("in_slice"))
        .select("stratum", "slice", F.coalesce(F.sum("in_slice").over(before), F.lit(0)).alias("before")),
        "shard-slices",
    )
    order = Window.partitionBy("stratum", "slice").orderBy(
        "key", "content_id", "script_crc32", "size"
    )
    place = sliced.withColumn("place", F.row_number().over(order))
    rank = F.col("before") + F.col("place")
    pieces = max(1, int(total**0.5))
    ranked = written(
        place.join(starts, ["stratum", "slice"])
        .withColumn("fraction", (2 * rank - 1) / (2 * F.col("n")))
        .withColumn("rank", rank)
        .withColumn("piece", F.floor(F.col("fraction") * pieces).cast("bigint"))
        .select("content_id", "blogger", "stratum", "size", "script_crc32", "fraction", "rank", "piece"),
        "shard-ranks",
    )
    pieces_before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    firsts = written(
        ranked.groupBy("piece")
        .agg(F.count(F.lit(1)).alias("in_piece"))
        .select("piece", F.coalesce(F.sum("in_piece").over(pieces_before), F.lit(0)).alias("first")),
        "shard-pieces",
    )
    mixed = Window.partitionBy("piece").orderBy("fraction", "stratum", "rank")
    position = F.col("first") + F.col("in_order") - 1
    return (
        ranked.withColumn("in_order", F.row_number().over(mixed))
        .join(firsts, "piece")
        .withColumn("position", position)
        .withColumn("shard", F.expr(f"cast(position * {shards} div {max(total, 1)} as int)"))
        .withColumn(
            "slot",
            F.col("position")
            - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}"),
        )
        .select("content_id", "blogger", "size", "script_crc32", "shard", "slot")
    )

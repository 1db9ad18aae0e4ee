"""Stand-in entities: the driver's tables seen as content-operations data.

Only this module and the query list know the driver's table and column names. Money is in whole
cents, so that sums are exact whatever the order they are added in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.functions.timing import epoch_seconds
from airloom.sources import load_table, stream_table

FUNNEL_STAGES = ("view", "click", "signup", "purchase")


def _cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("bigint")


def bloggers(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("blogger_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("type"),
        F.col("c_nationkey").alias("pool"),
    )


def content(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("content_id"),
        F.col("o_custkey").alias("blogger_id"),
        F.col("o_orderstatus").alias("status"),
        _cents("o_totalprice").alias("effect_cents"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("queue"),
    )


def programs(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue entries; the tags are the words of the title and the category."""
    return load_table(spark, folder, "part").select(
        F.col("p_partkey").alias("program_id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("channel"),
        F.col("p_size").alias("size"),
        _cents("p_retailprice").alias("price_cents"),
        F.concat(F.split("p_name", " "), F.array(F.lower("p_type"))).alias("tags"),
    )


def links(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("content_id"),
        F.col("l_partkey").alias("program_id"),
        F.col("l_linenumber").alias("ord"),
        F.col("l_returnflag").alias("phase"),
        (F.col("l_linestatus") == "F").alias("done"),
        F.col("l_extendedprice").alias("score"),
    )


def effect_events(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "events").select(
        "event_id", "ts", "user_id", "event_type", _cents("value").alias("value_cents")
    )


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Events with their JSON payload; every eleventh is cut off, as a broken one."""
    whole = F.col("props")
    cut = F.substring(whole, F.lit(1), F.length(whole) - 1)
    return load_table(spark, folder, "events").select(
        "event_id", "ts", "user_id", F.when(F.col("event_id") % 11 == 0, cut).otherwise(whole).alias("props")
    )


def status_events(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "events").select(
        F.col("user_id").alias("content_id"), "ts", "event_id", F.col("event_type").alias("status")
    )


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return stream_table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")


def weekly_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Four six-hour slots per creator, some past midnight, some overlapping.

    The higher a creator's balance, the more of the slots are enabled.
    """
    number, index = F.col("blogger_id"), F.col("slot")
    start = (number * 3 + index * 5) % 24
    return (
        load_table(spark, folder, "customer")
        .select(
            F.col("c_custkey").alias("blogger_id"),
            "c_acctbal",
            F.explode(F.sequence(F.lit(0), F.lit(3))).alias("slot"),
        )
        .select(
            "blogger_id",
            ((number + index * 2) % 7 + 1).cast("int").alias("dow"),
            start.cast("double").alias("start_h"),
            ((start + 6) % 24).cast("double").alias("end_h"),
            (F.col("c_acctbal") >= 1000 * index).alias("enabled"),
        )
    )


def excerpts(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    """Each event as an interval of as many minutes as its value, 30 at least."""
    events = load_table(spark, folder, "events")
    if kind is not None:
        events = events.where(F.col("event_type") == kind)
    start = epoch_seconds(events, "ts")
    length = F.greatest(F.floor(F.col("value")), F.lit(30)) * 60
    return events.select(
        F.col("user_id").alias("source_id"),
        F.col("event_id").alias("id"),
        start.alias("start_s"),
        (start + length).alias("end_s"),
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("n_chars").alias("length")
    )


def document_scores(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "labels").select(
        F.col("doc_id").alias("item_id"), F.col("quality").alias("score")
    )

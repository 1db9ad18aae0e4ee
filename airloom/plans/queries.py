"""The registered queries: every operator over the whole of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom import operators as ops
from airloom import sources
from airloom import streaming as live
from airloom.functions.timing import as_local_time, epoch_seconds
from airloom.plans import standins as std
from airloom.session import shared_folder, stored

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

AS_OF = "2024-01-20 10:30:00"
DAY_SUBJECT = ["user_id", "day"]
#: Seconds: the pause that ends a session, and the time a conversion may take.
SESSION_GAP = 4 * 3600
CONVERTS_WITHIN = 24 * 3600
#: Sketches of 512 hashes.
SKETCH_SIZE = 9
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _portable(df: DataFrame) -> DataFrame:
    """Result types every engine has: whole numbers as bigint, dates and times as text."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.IntegerType):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, TIME_FORMAT)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _portable(function(spark, folder))

    QUERIES[function.__name__] = run
    return run


def _daily_events(spark: SparkSession, folder: str) -> DataFrame:
    return std.effect_events(spark, folder).withColumn("day", F.to_date("ts"))


# Sources, search and facets


@query
def load_tables(spark, folder):
    tables = sources.load_tables(spark, folder, sorted(sources.SCHEMAS))
    checks = []
    for name, df in tables.items():
        nulls = [F.col(column).isNull().cast("int") for column in df.columns]
        digests = [F.coalesce(_digest(df, column), F.lit(0)) for column in df.columns]
        measures = [
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(reduce(Column.__add__, nulls)), F.lit(0)).alias("nulls"),
            F.coalesce(F.sum(reduce(Column.__add__, digests)), F.lit(0)).alias("checksum"),
        ]
        checks.append(df.agg(*measures).select(F.lit(name).alias("table_name"), "*"))
    return reduce(DataFrame.unionByName, checks)


def _digest(df: DataFrame, name: str) -> Column:
    """A whole number that follows from a value in any engine."""
    kind, value = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.StringType):
        return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("bigint")
    if isinstance(kind, T.DoubleType):
        return F.round(value * 100).cast("bigint")
    if isinstance(kind, T.TimestampNTZType):
        return epoch_seconds(df, name)
    if isinstance(kind, T.ArrayType):
        return F.aggregate(
            value, F.lit(0).cast("bigint"), lambda sum_, x: sum_ + F.round(x.cast("double") * 1000).cast("bigint")
        )
    return value.cast("bigint")


@query
def search_filter(spark, folder):
    found = ops.search_filter(
        std.programs(spark, folder), "RinG", ["title", "channel"], {"category": "PROMO"}
    )
    return found.select("program_id", "title", "channel", "category")


@query
def catalog_page(spark, folder):
    found = ops.search_filter(std.programs(spark, folder), "widget", ["title"])
    matches = found.select("program_id", "title", "price_cents")
    return ops.catalog_page(matches, [F.desc("price_cents"), F.asc("program_id")], 25)


@query
def facet_counts(spark, folder):
    return ops.facet_counts(std.programs(spark, folder), ["category", "channel", "size"])


@query
def status_tab_counts(spark, folder):
    return ops.status_tab_counts(std.content(spark, folder), "status")


# Key figures, trends and funnels


@query
def kpi_summary(spark, folder):
    bought = F.col("event_type") == "purchase"
    return ops.kpi_summary(
        std.effect_events(spark, folder),
        {
            "events": ops.Metric("count"),
            "users": ops.Metric("distinct", "user_id"),
            "purchases": ops.Metric("count", when=bought),
            "buyers": ops.Metric("distinct", "user_id", bought),
            "revenue_cents": ops.Metric("sum", "value_cents", bought),
        },
    )


@query
def kpi_summary_two_columns(spark, folder):
    return ops.kpi_summary(
        std.effect_events(spark, folder),
        {
            "users": ops.Metric("distinct", "user_id"),
            "kinds": ops.Metric("distinct", "event_type"),
            "events": ops.Metric("count"),
        },
    )


@query
def conversion_trend(spark, folder):
    return ops.conversion_trend(
        std.effect_events(spark, folder), "ts", "event_type", "view", "purchase"
    )


@query
def calendar_fill(spark, folder):
    daily = (
        std.content(spark, folder)
        .groupBy("status", "queue", F.to_date("created_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("items"))
    )
    return ops.calendar_fill(daily, "day", {"items": 0}, ["status", "queue"])


@query
def calendar_fill_by_user(spark, folder):
    daily = (
        _daily_events(spark, folder).groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))
    )
    return ops.calendar_fill(daily, "day", {"n": 0}, ["user_id"])


@query
def calendar_fill_range(spark, folder):
    daily = (
        std.content(spark, folder)
        .groupBy("status", F.to_date("created_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("items"))
    )
    return ops.calendar_fill(daily, "day", {"items": 0}, ["status"], "1992-12-20", "1996-02-10")


@query
def trend_by_kind(spark, folder):
    return ops.trend_by_kind(
        std.effect_events(spark, folder),
        "ts",
        "event_type",
        std.FUNNEL_STAGES,
        F.sum("value_cents"),
    )


@query
def ordered_funnel(spark, folder):
    return ops.ordered_funnel(
        _daily_events(spark, folder), DAY_SUBJECT, "ts", "event_type", std.FUNNEL_STAGES
    )


@query
def funnel_transitions(spark, folder):
    return ops.funnel_transitions(
        ops.ordered_funnel(
            _daily_events(spark, folder), DAY_SUBJECT, "ts", "event_type", std.FUNNEL_STAGES
        )
    )


@query
def funnel_split(spark, folder):
    subjects = std.bloggers(spark, folder).withColumnRenamed("blogger_id", "user_id")
    return ops.funnel_split(
        _daily_events(spark, folder),
        subjects,
        "user_id",
        "type",
        DAY_SUBJECT,
        "ts",
        "event_type",
        std.FUNNEL_STAGES,
    )


# Ranking and drilldown


@query
def effect_ranking(spark, folder):
    return ops.effect_ranking(
        std.content(spark, folder), "blogger_id", F.sum("effect_cents"), 20
    )


@query
def ranking_by_group(spark, folder):
    effects = (
        std.content(spark, folder)
        .groupBy("blogger_id")
        .agg(F.sum("effect_cents").alias("effect_cents"))
        .join(std.bloggers(spark, folder).select("blogger_id", "type"), "blogger_id")
    )
    return ops.ranking_by_group(effects, "type", [F.desc("effect_cents"), F.asc("blogger_id")], 10)


@query
def drilldown(spark, folder):
    return ops.drilldown(
        std.content(spark, folder),
        "blogger_id",
        "content_id",
        {
            "items": ("count", "content_id"),
            "effect_cents": ("sum", "effect_cents"),
            "best_cents": ("max", "effect_cents"),
            "mean_cents": ("avg", "effect_cents"),
        },
    )


@query
def entity_stats(spark, folder):
    published = std.content(spark, folder).where("status = 'P'")
    stats = ops.entity_stats(
        std.bloggers(spark, folder),
        published,
        "blogger_id",
        {
            "items": F.count(F.lit(1)),
            "effect_cents": F.sum("effect_cents"),
            "best_cents": F.max("effect_cents"),
            "queues": F.count_distinct("queue"),
        },
    )
    return stats.select("blogger_id", "name", "items", "effect_cents", "best_cents", "queues")


# Topics, tags and related items


def _topics(spark: SparkSession, folder: str, k: int) -> DataFrame:
    content = std.content(spark, folder).select(
        "content_id", "blogger_id", F.to_date("created_at").alias("day")
    )
    candidates = (
        std.links(spark, folder).select("content_id", "program_id", "score")
        .join(content, "content_id")
        .join(std.programs(spark, folder).select("program_id", "title"), "program_id")
    )
    return ops.topic_suggestions(candidates, ["blogger_id", "day"], "title", "score", k)


@query
def topic_suggestions_1(spark, folder):
    return _topics(spark, folder, 1)


@query
def topic_suggestions_2(spark, folder):
    return _topics(spark, folder, 2)


@query
def topic_suggestions_3(spark, folder):
    return _topics(spark, folder, 3)


@query
def tag_pool(spark, folder):
    items = std.programs(spark, folder).select(F.col("program_id").alias("item_id"), "tags")
    # A profile's tags are those of the programme it was started from, that of the same number.
    profiles = std.bloggers(spark, folder).join(
        items.withColumnRenamed("item_id", "blogger_id"), "blogger_id"
    )
    return ops.tag_pool(profiles, items, 5, profile="blogger_id")


@query
def dominance_counts(spark, folder):
    """Per programme, how many others are cheaper and larger."""
    programs = std.programs(spark, folder).select("program_id", "price_cents", "size")
    return ops.dominance_counts(programs, "price_cents", "size")


@query
def related_items(spark, folder):
    items = std.programs(spark, folder).select(F.col("program_id").alias("item_id"), "tags")
    return ops.related_items(items, 5, 0.4)


@query
def similar_items(spark, folder):
    """Per rank the links of the exact form, and whether 9 of 10 are as similar in the other one."""
    items = std.programs(spark, folder).select(F.col("program_id").alias("item_id"), "tags")
    exact = ops.related_items(items, 5, 0.4).select("item_id", "rank", "similarity")
    found = ops.similar_items(items, 5, 0.4).select("item_id", "rank", F.col("similarity").alias("found"))
    met = exact.join(found, ["item_id", "rank"], "left").groupBy("rank")
    return met.agg(
        F.count(F.lit(1)).alias("links"),
        (10 * F.count_if(F.col("found") == F.col("similarity")) >= 9 * F.count(F.lit(1))).alias("reached"),
    )


@query
def linked_programs(spark, folder):
    linked = ops.linked_programs(
        std.content(spark, folder).select("content_id"),
        std.links(spark, folder),
        std.programs(spark, folder).select("program_id", "title"),
        page_size=4,
    )
    text = F.transform(
        "programs", lambda p: F.concat_ws(":", p["ord"], p["program_id"], p["title"])
    )
    return linked.select("content_id", "page", F.array_join(text, ", ").alias("programs"))


@query
def expand_batch(spark, folder):
    return ops.expand_batch(std.bloggers(spark, folder).select("blogger_id"), 3)


# Production and review state


@query
def capacity_check(spark, folder):
    content = std.content(spark, folder)
    demand = content.where("status = 'O'").select("blogger_id", F.lit(5).alias("n"))
    supply = (
        content.where("status = 'F'").select("content_id", "blogger_id")
        .join(std.links(spark, folder).select("content_id", "program_id"), "content_id")
        .select("blogger_id", F.col("program_id").alias("item_id"))
    )
    return ops.capacity_check(demand, supply, "blogger_id")


@query
def shared_capacity_check(spark, folder):
    pools = std.bloggers(spark, folder).select("blogger_id", "pool")
    content = std.content(spark, folder)
    demand = (
        content.where("status = 'O'").join(pools, "blogger_id")
        .select(
            "pool",
            F.substring("queue", 1, 1).cast("int").alias("priority"),
            "content_id",
            (F.floor(F.col("effect_cents") / 5_000_000) + 1).alias("n"),
        )
    )
    supply = (
        content.where("status = 'F'").join(pools, "blogger_id").select("content_id", "pool")
        .join(std.links(spark, folder).select("content_id", "program_id"), "content_id")
        .select("pool", F.col("program_id").alias("item_id"))
    )
    return ops.shared_capacity_check(demand, supply, "pool", "priority", "content_id")


@query
def source_readiness(spark, folder):
    published = std.content(spark, folder).where("status = 'P'")
    return ops.source_readiness(std.bloggers(spark, folder), published, "blogger_id")


@query
def source_readiness_missing(spark, folder):
    published = std.content(spark, folder).where("status = 'P'")
    return ops.source_readiness(std.bloggers(spark, folder), published, "blogger_id", ready=False)


@query
def batch_progress(spark, folder):
    return ops.batch_progress(std.links(spark, folder), "content_id", "ord", "done", "phase")


@query
def queue_position(spark, folder):
    waiting = std.content(spark, folder).withColumn("done", F.col("status") != "O")
    placed = ops.queue_position(waiting, "queue", "created_at", "content_id", "done")
    return placed.select("content_id", "queue", "created_at", "position")


@query
def current_status(spark, folder):
    events = std.status_events(spark, folder).withColumnRenamed("content_id", "blogger_id")
    return ops.current_status(
        events,
        "blogger_id",
        "ts",
        AS_OF,
        pending=["error"],
        slots=std.weekly_slots(spark, folder),
    )


@query
def status_history(spark, folder):
    return ops.status_history(std.status_events(spark, folder), "content_id", "ts", "status")


@query
def checklist_complete(spark, folder):
    programs = std.programs(spark, folder).select("program_id", "category")
    checks = (
        std.links(spark, folder).select("content_id", "program_id").join(programs, "program_id")
    )
    required = programs.where(F.col("category").startswith("S")).select("category")
    return ops.checklist_complete(checks, required, "content_id", "category")


@query
def checklist_complete_only(spark, folder):
    programs = std.programs(spark, folder).select("program_id", "category")
    checks = (
        std.links(spark, folder).select("content_id", "program_id").join(programs, "program_id")
    )
    required = programs.where(F.col("category").startswith("S")).select("category")
    return ops.checklist_complete(checks, required, "content_id", "category", only_complete=True)


@query
def return_reasons(spark, folder):
    returned = (
        std.links(spark, folder).where("phase = 'R'").select("content_id", "program_id")
        .join(std.programs(spark, folder).select("program_id", "tags"), "program_id")
    )
    return ops.return_reasons(returned, "content_id", "tags")


@query
def content_profile(spark, folder):
    return ops.content_profile(
        std.documents(spark, folder),
        std.document_scores(spark, folder),
        "item_id",
        "length",
        [500, 2000, 8000],
    )


@query
def content_profile_median(spark, folder):
    """Of whole numbers with few different values, for which the median is exact."""
    scores = std.documents(spark, folder).select("item_id", (F.col("length") % 50).alias("score"))
    return ops.content_profile(
        std.documents(spark, folder), scores, "item_id", "length", [500, 2000, 8000], median=True
    )


@query
def new_entities(spark, folder):
    return ops.new_entities(
        std.content(spark, folder), "blogger_id", "created_at", "1995-06-30", 30
    )


# Values, sessions and conversions by time


def _purchases_and_states(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Purchases, and all other events as changes of the same content's status."""
    events = std.status_events(spark, folder)
    return events.where("status = 'purchase'").drop("status"), events.where("status <> 'purchase'")


@query
def status_as_of(spark, folder):
    purchases, states = _purchases_and_states(spark, folder)
    return ops.status_as_of(purchases, states, "content_id", "ts")


@query
def status_after(spark, folder):
    purchases, states = _purchases_and_states(spark, folder)
    return ops.as_of_join(
        purchases,
        states,
        ["content_id"],
        "ts",
        {"status": "status", "at": "ts"},
        "event_id",
        direction="forward",
        within_s=6 * 3600,
    )


@query
def nearest_status(spark, folder):
    purchases, states = _purchases_and_states(spark, folder)
    return ops.as_of_join(
        purchases, states, ["content_id"], "ts", {"status": "status", "at": "ts"}, "event_id", direction="nearest"
    )


@query
def sessions(spark, folder):
    bought = F.sum(F.when(F.col("event_type") == "purchase", F.col("value_cents")))
    measures = {"kinds": F.count_distinct("event_type"), "revenue_cents": F.coalesce(bought, F.lit(0))}
    return ops.sessions(std.effect_events(spark, folder), "user_id", "ts", SESSION_GAP, measures)


@query
def conversions_within(spark, folder):
    events = std.effect_events(spark, folder)
    views, purchases = (events.where(F.col("event_type") == kind) for kind in ("view", "purchase"))
    return ops.conversions_within(views, purchases, "user_id", "ts", CONVERTS_WITHIN)


# Sketches, windows, payloads and changes


def _active_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of the active bloggers per queue and day, as they would be stored."""
    content = std.content(spark, folder).withColumn("day", F.to_date("created_at"))
    sketches = ops.distinct_sketches(content, ["queue", "day"], "blogger_id", SKETCH_SIZE)
    return stored(sketches, "sketches")


@query
def distinct_counts(spark, folder):
    in_range = F.col("day").between("1994-03-01", "1995-10-31")
    estimates = ops.distinct_counts(_active_sketches(spark, folder).where(in_range), ["queue"], SKETCH_SIZE)
    content = std.content(spark, folder).withColumn("day", F.to_date("created_at")).where(in_range)
    exact = content.groupBy("queue").agg(F.count_distinct("blogger_id").alias("bloggers"))
    return estimates.join(exact, "queue").select(
        "queue", "bloggers", F.col("bloggers").between(F.col("low"), F.col("high")).alias("within")
    )


@query
def distinct_shared(spark, folder):
    sketches = _active_sketches(spark, folder).withColumn("year", F.year("day"))
    estimates = ops.distinct_shared(sketches, ["queue"], "year", [1994, 1995, 1996], SKETCH_SIZE)
    years = std.content(spark, folder).select("queue", "blogger_id", F.year("created_at").alias("year"))
    active = years.where(F.col("year").isin(1994, 1995, 1996)).groupBy("queue", "blogger_id")
    active = active.agg(F.count_distinct("year").alias("years"))
    exact = active.groupBy("queue").agg(F.count_if(F.col("years") == 3).alias("bloggers"))
    return estimates.join(exact, "queue").select(
        "queue", "bloggers", F.col("bloggers").between(F.col("low"), F.col("high")).alias("within")
    )


@query
def sliding_windows(spark, folder):
    return ops.sliding_windows(
        std.effect_events(spark, folder),
        "ts",
        7 * 86400,
        86400,
        {
            "events": ("count", None),
            "total_cents": ("sum", "value_cents"),
            "least_cents": ("min", "value_cents"),
            "most_cents": ("max", "value_cents"),
            "mean_cents": ("avg", "value_cents"),
        },
        ["event_type"],
    )


@query
def merged_props(spark, folder):
    merged = ops.merged_props(std.payloads(spark, folder), "user_id", "ts")

    def listed(name: str) -> Column:
        entries = F.transform(F.map_entries(name), lambda e: F.concat_ws("=", e.key, e.value.cast("string")))
        return F.array_join(entries, ",").alias(name)

    return merged.select("user_id", listed("latest"), listed("totals"), listed("times"), "events", "broken")


@query
def state_changes(spark, folder):
    content = std.content(spark, folder)
    states = [
        content.where(F.year("created_at") == year).select("blogger_id", "status", "queue") for year in (1995, 1996)
    ]
    return ops.state_changes(*states)


# Schedule and intervals


@query
def events_in_schedule(spark, folder):
    events = std.effect_events(spark, folder).select(
        "event_id", F.col("user_id").alias("blogger_id"), "ts"
    )
    return ops.events_in_schedule(events, std.weekly_slots(spark, folder), "blogger_id", "ts")


@query
def schedule_summary(spark, folder):
    return ops.schedule_summary(
        std.bloggers(spark, folder).select("blogger_id", "name"), std.weekly_slots(spark, folder)
    )


@query
def merge_intervals(spark, folder):
    return ops.merge_intervals(std.excerpts(spark, folder), "source_id", "start_s", "end_s")


@query
def timeline_overlap(spark, folder):
    return ops.timeline_overlap(
        std.excerpts(spark, folder, "view"),
        std.excerpts(spark, folder, "click"),
        "source_id",
    )


@query
def timeline_overlap_buckets(spark, folder):
    return ops.timeline_overlap(
        std.excerpts(spark, folder, "view"),
        std.excerpts(spark, folder, "signup"),
        "source_id",
        bucket=3600,
    )


@query
def timeline_overlap_keyless(spark, folder):
    """Purchases and errors that overlap, whoever's they are, summed up by the hour."""
    sides = (std.excerpts(spark, folder, kind).drop("source_id") for kind in ("purchase", "error"))
    pairs = ops.timeline_overlap(*sides, None)
    by_hour = F.floor(F.col("overlap_start") / 3600).alias("hour")
    return pairs.groupBy(by_hour).agg(F.count(F.lit(1)).alias("pairs"), F.sum("overlap").alias("seconds"))


# Streaming forms, run over what there is


def _stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same cluster with one state partition per core.

    A stream keeps a state store for each shuffle partition, for as long as it lives. The general
    setting is made for batches and would be far too many, or too few.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    return session


def _append(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    folder = shared_folder(spark, name)
    parquet = stream.writeStream.outputMode("append").format("parquet")
    writer = parquet.option("path", f"{folder}/out")
    live.run_to_end(writer, f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query
def live_counts(spark, folder):
    counts = live.live_counts(
        std.event_stream(_stream_session(spark), folder), "ts", "1 day", "1 hour", ["event_type"]
    )
    return _append(spark, counts, "live_counts")


@query
def live_dedup(spark, folder):
    events = std.event_stream(_stream_session(spark), folder)
    replayed = events.unionByName(events)
    once = live.live_dedup(replayed, "event_id", "ts", "1 hour")
    return _append(spark, once.withColumn("ts", as_local_time(F.col("ts"))), "live_dedup")


@query
def live_status(spark, folder):
    target = shared_folder(spark, "live_status")
    stream = std.event_stream(_stream_session(spark), folder).withColumnsRenamed(
        {"user_id": "content_id", "event_type": "status"}
    )
    writer = live.live_status(stream, "content_id", "ts", f"{target}/log")
    live.run_to_end(writer, f"{target}/checkpoint")
    return live.latest_status(spark, f"{target}/log", "content_id")


@query
def live_sessions(spark, folder):
    events = std.event_stream(_stream_session(spark), folder)
    return _append(spark, live.live_sessions(events, "user_id", "ts", SESSION_GAP, "1 hour"), "live_sessions")


@query
def live_conversions(spark, folder):
    events = std.event_stream(_stream_session(spark), folder)
    views, purchases = (events.where(F.col("event_type") == kind) for kind in ("view", "purchase"))
    pairs = live.live_conversions(views, purchases, "user_id", "ts", CONVERTS_WITHIN, "1 hour")
    return _append(spark, pairs, "live_conversions")


@query
def live_states(spark, folder):
    session = _stream_session(spark)
    for name, value in live.STATE_STORE.items():
        session.conf.set(name, value)
    events = std.event_stream(session, folder).withColumnsRenamed({"user_id": "blogger_id", "event_type": "status"})
    slots = std.weekly_slots(session, folder)
    states = live.live_states(events, slots, "blogger_id", "ts", "1 hour", 3, pending=["error"])
    return _append(spark, states, "live_states")

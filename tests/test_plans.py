"""What the plans must and must not contain, so that a change cannot slow them down unseen."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from airloom import operators as ops
from airloom.plans import standins as std
from airloom.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
STREAMING = {name for name in QUERIES if name.startswith("live_")}
#: The payload is what this query is about.
PAYLOAD = {"merged_props"}
BATCH = sorted(set(QUERIES) - STREAMING)


def plan(spark, name):
    text = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    return re.sub(r"#\d+L?", "", text)


@pytest.fixture
def no_broadcast(spark):
    """Plans as for tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", BATCH)
def test_no_pairing_and_no_python(spark, no_broadcast, name):
    text = plan(spark, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert operator not in text
    assert "BroadcastHashJoin" not in text  # no broadcast is forced by a hint


@pytest.mark.parametrize("name", [name for name in BATCH if name != "load_tables"])
def test_scans_read_only_needed_columns(spark, name):
    widths = {"events": 6, "lineitem": 11, "orders": 6, "documents": 5}
    for schema in re.findall(r"ReadSchema: struct<(.*?)>", plan(spark, name)):
        columns = [part for part in schema.split(",") if part]
        wide = ("text:", "html:") if name in PAYLOAD else ("text:", "html:", "props:")
        assert not any(part.startswith(wide) for part in columns)
        assert len(columns) < max(widths.values())


@pytest.mark.parametrize(
    ("name", "pushed"),
    [
        ("search_filter", "EqualTo(p_type,PROMO)"),
        ("conversion_trend", "In(event_type, [purchase,view])"),
        ("ordered_funnel", "In(event_type, [click,purchase,signup,view])"),
        ("entity_stats", "EqualTo(o_orderstatus,P)"),
        ("source_readiness", "EqualTo(o_orderstatus,P)"),
        ("return_reasons", "EqualTo(l_returnflag,R)"),
        ("timeline_overlap", "EqualTo(event_type,view)"),
    ],
)
def test_filters_reach_the_scan(spark, name, pushed):
    text = plan(spark, name)
    assert pushed in text.replace("(o_orderstatus, P)", "(o_orderstatus,P)")


@pytest.mark.parametrize("name", ["catalog_page", "effect_ranking"])
def test_top_n_keeps_n_rows_per_task(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize(
    "name", ["ranking_by_group", "topic_suggestions_3", "related_items", "tag_pool"]
)
def test_groups_are_cut_before_the_shuffle(spark, no_broadcast, name):
    text = plan(spark, name)
    assert re.search(r"WindowGroupLimit .*Partial", text)
    assert re.search(r"WindowGroupLimit .*Final", text)


@pytest.mark.parametrize(
    "name",
    ["ordered_funnel", "status_history", "queue_position", "shared_capacity_check"],
)
def test_rows_are_windowed_within_slices(spark, no_broadcast, name):
    """Wherever a window runs over a key alone, its input was aggregated to slices before."""
    lines = plan(spark, name).splitlines()
    by_key = []
    for index, line in enumerate(lines):
        found = re.search(r"Window \[.* AS \w+\], \[([^\]]*)\]", line)
        if found and "_slice" not in found.group(1):
            depth = len(line) - len(line.lstrip(" :+-"))
            below = []
            for later in lines[index + 1 :]:
                if len(later) - len(later.lstrip(" :+-")) <= depth:
                    break
                below.append(later)
            by_key.append("\n".join(below))
    assert by_key
    for below in by_key:
        aggregate = re.search(r"(Hash|Sort)Aggregate\(key=?s?=?\[[^\]]*_slice", below)
        assert aggregate, below


def test_funnel_shuffles_rows_once_and_slices_once(spark):
    text = plan(spark, "ordered_funnel")
    exchanges = re.findall(r"Exchange (\w+)", text.split("Initial Plan")[0])
    assert exchanges == ["SinglePartition", "hashpartitioning", "hashpartitioning"]


@pytest.mark.parametrize("name", ["merge_intervals", "drilldown"])
def test_input_is_read_and_shuffled_once(spark, no_broadcast, name):
    excerpts = std.excerpts(spark, FOLDER)
    df = {
        "drilldown": lambda: QUERIES[name](spark, FOLDER),
        "merge_intervals": lambda: ops.merge_intervals(
            excerpts, "source_id", "start_s", "end_s", slice_width=3600
        ),
    }[name]()
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final
    assert final.count("FileScan") == 1


def test_time_slices_of_a_queue_need_no_table(spark):
    waiting = std.content(spark, FOLDER)
    placed = ops.queue_position(waiting, "queue", "created_at", "content_id", slice_minutes=1440)
    text = placed._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(o_orderpriority)" in text
    assert "/slices-" not in text


@pytest.mark.parametrize("name", ["queue_position", "status_history", "merge_intervals"])
def test_sliced_queries_go_on_from_the_slices(spark, name):
    """The tables are read while the slices are written, and not again for the totals."""
    text = plan(spark, name)
    assert "/slices-" in text
    assert not re.search(r"/(orders|events)\.parquet", text)


def test_returned_items_are_counted_in_one_pass(spark, no_broadcast):
    df = QUERIES["return_reasons"](spark, FOLDER)
    _, final = final_plan(df)
    # The base is made of the aggregation by reason, below which nothing is computed again.
    assert re.search(r"ReusedExchange \[reason", final)


@pytest.mark.parametrize("name", ["status_history", "queue_position", "shared_capacity_check"])
def test_windowed_rows_are_sorted_once(spark, no_broadcast, name):
    """The join that brings the carry adds no exchange or sort above the window."""
    text = plan(spark, name)
    below_join = text[text.index("SortMergeJoin [") :]
    first = re.search(r"(Window|Exchange|Sort) \[?", below_join.split("\n", 1)[1])
    assert first.group(1) == "Window"


@pytest.fixture
def eager_skew_handling(spark, no_broadcast):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def final_plan(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def spread(spark, df, folder):
    """The same rows as many files, as a skewed partition is split between map tasks."""
    df.repartition(16).write.parquet(folder)
    return spark.read.parquet(folder)


def test_a_hot_creator_is_spread_in_the_schedule_join(spark, eager_skew_handling, tmp_path):
    creator = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500)
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    events = spread(
        spark,
        spark.range(6000).select(
            "id",
            creator.alias("blogger_id"),
            (start + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"),
        ),
        str(tmp_path / "events"),
    )
    slots = std.weekly_slots(spark, FOLDER)
    marked = ops.events_in_schedule(events, slots, "blogger_id", "ts")
    tasks = marked.where("blogger_id = 0").select(F.spark_partition_id().alias("task"))
    sizes = [row["count"] for row in tasks.groupBy("task").count().collect()]
    assert sum(sizes) > 2000
    assert max(sizes) <= 1000


@pytest.mark.parametrize(
    ("name", "key", "joins"),
    [
        ("events_in_schedule", "blogger_id", 1),
        ("checklist_complete", "category", 1),
        ("tag_pool", "_set", 1),
        ("related_items", "_set", 1),
    ],
)
def test_hot_keys_are_salted(spark, no_broadcast, name, key, joins):
    found = re.findall(rf"SortMergeJoin \[{key}, _salt\], \[{key}, _salt\]", plan(spark, name))
    assert len(found) == joins
    shuffled = re.findall(rf"Exchange hashpartitioning\({key}, _salt, ", plan(spark, name))
    assert len(shuffled) == 2 * joins


def test_salted_copies_are_never_broadcast(spark):
    # The tables are small here, and so they seem to be to Spark where they are not.
    assert "Broadcast" not in plan(spark, "events_in_schedule")


def test_the_pages_of_a_hot_item_are_split(spark, eager_skew_handling, tmp_path):
    item = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500)
    links = spread(
        spark,
        spark.range(9000).select(
            item.alias("content_id"), (F.col("id") % 20).alias("program_id"), (F.col("id") + 1).alias("ord")
        ),
        str(tmp_path / "links"),
    )
    content = spark.range(500).withColumnRenamed("id", "content_id")
    programs = spark.range(20).withColumnRenamed("id", "program_id")
    linked = ops.linked_programs(content, links, programs, page_size=5)
    rows, final = final_plan(linked)
    assert sum(len(row.programs) for row in rows) == 9000
    assert max(len(row.programs) for row in rows) <= 5
    assert "skew=true" in final


def test_results_do_not_depend_on_the_session_time_zone(spark):
    names = ["ordered_funnel", "status_history", "events_in_schedule", "current_status",
             "merge_intervals", "new_entities", "queue_position", "live_counts"]

    def results():
        return {name: sorted(map(str, QUERIES[name](spark, FOLDER).collect())) for name in names}

    expected = results()
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kathmandu")
    try:
        assert results() == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_standins_share_no_names_with_the_driver_tables(spark):
    for entity in (std.bloggers, std.content, std.programs, std.links):
        assert not [c for c in entity(spark, FOLDER).columns if re.match(r"[colp]_", c)]

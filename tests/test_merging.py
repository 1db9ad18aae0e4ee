"""Sketches, panes, payloads and change lists against plain computations."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from airloom import operators as ops
from tests.conftest import rows_of

START = datetime(2024, 1, 1)


# Sketches


def test_sketches_are_exact_while_small_and_within_bounds_beyond(spark):
    rng = random.Random(1)
    rows = [(d, k, rng.randrange(20_000)) for d in range(5) for k in "ab" for _ in range(4000)] + [(0, "a", None)] * 9
    events = spark.createDataFrame(rows, "day int, kind string, user bigint").repartition(6)
    sketches = ops.distinct_sketches(events, ["day", "kind"], "user", 10)
    assert sketches.count() == 10
    for days in ([0], [1, 2], [0, 1, 2, 3, 4]):
        found = ops.distinct_counts(sketches.where(F.col("day").isin(days)), ["kind"], 10).collect()
        for r in found:
            exact = len({u for d, k, u in rows if d in days and k == r.kind and u is not None})
            assert r.low <= exact <= r.high and r.high - r.low < 0.25 * exact
    few = events.where("user < 300")
    small = ops.distinct_sketches(few, ["day", "kind"], "user", 10)
    for r in ops.distinct_counts(small, ["day"], 10).collect():
        exact = len({u for d, _, u in rows if d == r.day and u is not None and u < 300})
        assert r.estimate == r.low == r.high == exact


def test_sketches_intersect(spark):
    rows = [("g", k, u) for k, users in (("a", range(0, 6000)), ("b", range(3000, 9000)), ("c", range(5000, 9000))) for u in users]
    rows += [("h", "a", 1), ("h", "b", 2), ("h", "b", 1), ("i", "a", 1)]
    sketches = ops.distinct_sketches(spark.createDataFrame(rows, "g string, kind string, user bigint"), ["g", "kind"], "user", 9)
    two = {r.g: r for r in ops.distinct_shared(sketches, ["g"], "kind", ["a", "b"], 9).collect()}
    assert two["g"].low <= 3000 <= two["g"].high and two["g"].low > 1000
    assert (two["h"].estimate, two["h"].low, two["h"].high) == (1, 1.0, 1.0) and two["i"].estimate == 0
    three = {r.g: r for r in ops.distinct_shared(sketches, ["g"], "kind", ["a", "b", "c"], 9).collect()}
    assert three["g"].low <= 1000 <= three["g"].high and three["h"].estimate == 0
    with pytest.raises(ValueError):
        ops.distinct_shared(sketches, ["g"], "kind", [])


def test_sketches_of_nothing(spark):
    events = spark.createDataFrame([("x", None)], "kind string, user bigint")
    sketches = ops.distinct_sketches(events, ["kind"], "user")
    assert rows_of(ops.distinct_counts(sketches, ["kind"])) == [("x", 0, 0.0, 0.0)]
    assert ops.distinct_counts(sketches.limit(0), ["kind"]).count() == 0


# Sliding windows


@pytest.mark.parametrize(("width", "step"), [(60, 60), (300, 60), (90, 60), (60, 90), (7, 5), (3600, 7)])
def test_windows_equal_every_event_in_every_window(spark, width, step):
    rng = random.Random(width * step)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 900, 3), 5000, 5001]), rng.choice([None, 1, 2, 5])) for _ in range(150)]
    events = spark.createDataFrame([(k, t if t is None else START + timedelta(seconds=t), v) for k, t, v in rows], "kind string, at timestamp_ntz, value int")
    measures = {"n": ("count", None), "given": ("count", "value"), "total": ("sum", "value"), "least": ("min", "value"), "most": ("max", "value"), "mean": ("avg", "value")}
    found = ops.sliding_windows(events, "at", width, step, measures, ["kind"])
    held = defaultdict(list)
    epoch = int((START - datetime(1970, 1, 1)).total_seconds())
    for kind, t, value in rows:
        if t is not None:
            last = (epoch + t) // step * step
            for start in range(last, last - width - step, -step):
                if start <= epoch + t < start + width:
                    held[kind, start - epoch].append(value)
    expected = []
    for (kind, start), values in held.items():
        known = [v for v in values if v is not None]
        given = (sum(known), min(known), max(known), sum(known) / len(known)) if known else (None,) * 4
        expected.append((kind, START + timedelta(seconds=start), START + timedelta(seconds=start + width), len(values), len(known), *given))
    assert sorted(map(str, rows_of(found))) == sorted(map(str, expected))


def test_windows_without_groups_and_of_instants(spark):
    events = spark.createDataFrame([(START,), (START + timedelta(seconds=61),)], "at timestamp")
    found = ops.sliding_windows(events, "at", 120, 60, {"n": ("count", None)}).collect()
    assert sorted((int((r.window_start - START).total_seconds()), r.n) for r in found) == [(-60, 1), (0, 2), (60, 1)]
    assert ops.sliding_windows(events.limit(0), "at", 120, 60, {"n": ("count", None)}).count() == 0
    for width, step, how in ((0, 1, "sum"), (1, 0, "sum"), (1, 1, "median")):
        with pytest.raises(ValueError):
            ops.sliding_windows(events, "at", width, step, {"n": (how, "at")})


def test_windows_copy_no_events(spark, tmp_path):
    """Events are aggregated by pane before anything is generated, and read once."""
    spark.range(10).selectExpr("timestamp_ntz'2024-01-01' AS at").write.parquet(f"{tmp_path}/e")
    found = ops.sliding_windows(spark.read.parquet(f"{tmp_path}/e"), "at", 7 * 86400, 86400, {"n": ("count", None)})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate") < plan.index("Relation")
    assert "Expand" not in plan and plan.count("Relation") == 1 and plan.count("Generate") == 1


# Payloads

PAYLOADS = [
    ('{"k": 69}', {"k": "69"}, {"k": 69.0}, False),
    ('{"a": "x", "b": "7.5", "c": null, "d": {"e": 1}, "f": [1, 2], "g": true}', {"a": "x", "b": "7.5", "c": None, "d": '{"e":1}', "f": "[1,2]", "g": "true"}, {"b": 7.5}, False),
    ("{}", {}, {}, False),
    (' {"k" : 1 } ', {"k": "1"}, {"k": 1.0}, False),
    ('{"k": 69', None, None, True),
    ('{"k": }', None, None, True),
    ("", None, None, True),
    ("[1]", None, None, True),
    ("5", None, None, True),
    ("null", None, None, True),
    ("no json", None, None, True),
    (None, None, None, False),
    ('{"n": "NaN", "i": "Infinity", "é": "ü"}', {"n": "NaN", "i": "Infinity", "é": "ü"}, {}, False),
]


def test_payloads_are_parsed_or_marked(spark):
    rows = [(i, p[0], "old") for i, p in enumerate(PAYLOADS)]
    events = spark.createDataFrame(rows, "id int, props string, broken string")
    found = {r.id: r for r in ops.parsed_props(events).collect()}
    for i, (text, values, numbers, broken) in enumerate(PAYLOADS):
        assert (found[i].prop_values, found[i].prop_numbers, found[i].broken) == (values, numbers, broken), text


def test_payloads_merge_per_key(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        names = rng.sample("abcd", rng.randrange(3))
        text = json.dumps({n: rng.choice([1, 2.5, "x", None]) for n in names})
        key = 1 if rng.random() < 0.5 else rng.choice([2, 3, None])
        rows.append((key, START + timedelta(seconds=rng.randrange(50)), i, rng.choice([text, text, text, None, "{"])))
    events = spark.createDataFrame(rows, "key bigint, ts timestamp_ntz, event_id bigint, props string").repartition(5)
    found = {r.key: r for r in ops.merged_props(events, "key", "ts").collect()}
    expected = defaultdict(lambda: {"latest": {}, "totals": Counter(), "times": Counter(), "events": 0, "broken": 0})
    for key, ts, i, text in sorted(rows, key=lambda r: (r[1], r[2])):
        if key is None:
            continue
        into = expected[key]
        into["events"] += 1
        into["broken"] += text == "{"
        for name, value in json.loads(text).items() if text not in (None, "{") else ():
            into["latest"][name] = None if value is None else str(value)
            into["times"][name] += 1
            if isinstance(value, (int, float)):
                into["totals"][name] += value
    assert set(found) == set(expected)
    for key, into in expected.items():
        r = found[key]
        assert (r.latest, r.times, r.events, r.broken) == (into["latest"], dict(into["times"]), into["events"], into["broken"])
        assert {n: float(v) for n, v in r.totals.items()} == dict(into["totals"])


def test_keys_without_a_name_and_no_events(spark):
    kind = "key bigint, ts timestamp_ntz, event_id bigint, props string"
    events = spark.createDataFrame([(1, START, 1, "{}"), (1, START, 1, "{}"), (2, START, 2, None), (3, None, None, "{")], kind)
    found = {r.key: (r.latest, r.totals, r.times, r.events, r.broken) for r in ops.merged_props(events, "key", "ts").collect()}
    assert found == {1: ({}, {}, {}, 2, 0), 2: ({}, {}, {}, 1, 0), 3: ({}, {}, {}, 1, 1)}
    assert ops.merged_props(events.limit(0), "key", "ts").count() == 0


# Changes


def test_change_list_equals_multiset_operations(spark):
    rng = random.Random(5)
    kind = "a int, `b.c` string, tags array<string>"
    states = [
        spark.createDataFrame([(rng.choice([1, 2, None]), rng.choice(["x", None]), rng.choice([["t"], [], None])) for _ in range(n)], kind)
        for n in (200, 150)
    ]
    before, after = states
    found = ops.state_changes(before, after.select("tags", "a", "`b.c`")).collect()
    got = Counter({(str((r["a"], r["b.c"], r["tags"])), r.change): r.n for r in found})
    expected = Counter()
    for change, df in (("added", after.exceptAll(before)), ("removed", before.exceptAll(after)), ("kept", before.intersectAll(after))):
        expected.update((str((r["a"], r["b.c"], r["tags"])), change) for r in df.collect())
    assert got == expected and set(c for _, c in got) == {"added", "kept", "removed"}


def test_changes_of_equal_empty_and_unlike_states(spark):
    state = spark.createDataFrame([(1,), (1,), (None,)], "a int")
    assert rows_of(ops.state_changes(state, state)) == [(1, "kept", 2), (None, "kept", 1)]
    assert rows_of(ops.state_changes(state.limit(0), state)) == [(1, "added", 2), (None, "added", 1)]
    assert ops.state_changes(state.limit(0), state.limit(0)).count() == 0
    for other in (state.withColumn("b", F.lit(1)), state.withColumnRenamed("a", "b")):
        with pytest.raises(ValueError):
            ops.state_changes(state, other)
    named = state.withColumn("n", F.lit(1))
    with pytest.raises(ValueError):
        ops.state_changes(named, named)

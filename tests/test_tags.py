from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from airloom import operators as ops
from tests.conftest import rows_of


def random_items(seed, count):
    rng = random.Random(seed)
    rows = []
    for number in range(count):
        if number % 3 == 0:
            tags = ["hot", "same"]  # a third of all items have the same tags
        else:
            tags = [rng.choice("abcdef") for _ in range(rng.randrange(0, 5))] + ["hot"]
            rng.shuffle(tags)
        rows.append((number, tags))
    rows += [(count, []), (count + 1, None), (count + 2, ["lonely", None])]
    return rows


def clean(tags):
    return {tag for tag in tags or [] if tag is not None}


@pytest.mark.parametrize(("m", "min_sim"), [(1, 0.0), (3, 0.0), (4, 0.5), (2, 1.0), (500, 0.3)])
def test_related_items_equal_brute_force(frame, m, min_sim):
    rows = random_items(m, 120)
    result = ops.related_items(frame(rows, "item_id bigint, tags array<string>"), m, min_sim)
    sets = {number: clean(tags) for number, tags in rows}
    expected = []
    for a, own in sets.items():
        found = []
        for b, other in sets.items():
            if a != b and own & other:
                similarity = len(own & other) / len(own | other)
                if similarity >= min_sim:
                    found.append((-similarity, b))
        for rank, (similarity, b) in enumerate(sorted(found)[:m], 1):
            expected.append((a, rank, b, -similarity))
    key = lambda row: row[:3]
    assert sorted(map(tuple, result.collect()), key=key) == sorted(expected, key=key)


def test_related_items_are_symmetric_before_the_cut(frame):
    rows = random_items(9, 60)
    result = ops.related_items(frame(rows, "item_id bigint, tags array<string>"), 1000)
    pairs = {(row.item_id, row.related_item_id, row.similarity) for row in result.collect()}
    assert pairs == {(b, a, similarity) for a, b, similarity in pairs}


@pytest.mark.parametrize("m", [1, 4, 200])
def test_tag_pool_equals_brute_force(frame, m):
    items = random_items(m, 90)
    profiles = [(n, tags) for n, tags in random_items(m + 1, 30)]
    profiles.append((999, ["unknown"]))
    result = ops.tag_pool(
        frame(profiles, "profile_id bigint, tags array<string>"),
        frame(items, "item_id bigint, tags array<string>"),
        m,
    )
    expected = []
    for profile, tags in profiles:
        found = sorted(
            (-len(clean(tags) & clean(other)), item)
            for item, other in items
            if clean(tags) & clean(other)
        )
        for rank, (shared, item) in enumerate(found[:m], 1):
            expected.append((profile, len(found), rank, item, -shared))
        if not found:
            expected.append((profile, 0, None, None, None))
    assert rows_of(result) == sorted(expected, key=lambda r: [(v is None, str(v)) for v in r])


def wide_items(width, count=40, tags=45):
    rng = random.Random(width)
    pool = [f"t{number:02}" for number in range(tags)]
    return [(number, rng.sample(pool, width)) for number in range(count)]


def best_related(rows, m, min_sim):
    expected = []
    for a, own in rows:
        found = []
        for b, other in rows:
            shared = len(set(own) & set(other))
            similarity = shared / len(set(own) | set(other))
            if a != b and shared and similarity >= min_sim:
                found.append((-similarity, b))
        expected += [(a, rank, b, -s) for rank, (s, b) in enumerate(sorted(found)[:m], 1)]
    return sorted(expected)


@pytest.mark.parametrize("width", [13, 20, 30])
def test_sets_of_any_width_equal_brute_force(frame, width):
    rows = wide_items(width)
    items = frame(rows, "item_id bigint, tags array<string>")
    assert sorted(map(tuple, ops.related_items(items, 3, 0.2).collect())) == best_related(rows, 3, 0.2)
    profiles = rows[:5] + [(900, ["t00"]), (901, rows[0][1][:2])]
    expected = []
    for profile, own in profiles:
        found = sorted((-len(set(own) & set(o)), b) for b, o in rows if set(own) & set(o))
        expected += [(profile, len(found), r, b, -s) for r, (s, b) in enumerate(found[:3], 1)]
    pool = ops.tag_pool(frame(profiles, "profile_id bigint, tags array<string>"), items, 3)
    assert sorted(map(tuple, pool.collect())) == sorted(expected)


@pytest.mark.parametrize("pair_limit", [1, 5])
def test_growing_prefixes_equals_brute_force(frame, pair_limit):
    rows = [(n, t[:4]) for n, t in wide_items(13, 60, 14)] + [(100 + n, ["t00", "t01"]) for n in range(9)]
    items = frame(rows, "item_id bigint, tags array<string>")
    for m, min_sim in [(2, 0.0), (3, 0.5)][: pair_limit]:
        found = ops.related_items(items, m, min_sim, pair_limit=pair_limit)
        assert sorted(map(tuple, found.collect())) == best_related(rows, m, min_sim)
    pool = ops.tag_pool(items.withColumnRenamed("item_id", "profile_id"), items, 3, pair_limit=pair_limit)
    expected = []
    for profile, own in rows:
        found = sorted((-len(set(own) & set(o)), b) for b, o in rows if set(own) & set(o))
        expected += [(profile, len(found), r, b, -s) for r, (s, b) in enumerate(found[:3], 1)]
    assert sorted(map(tuple, pool.collect())) == sorted(expected)


def test_linked_programs_in_order_and_in_pages(frame):
    content = frame([(1,), (2,), (3,)], "content_id bigint")
    programs = frame([(10, "x"), (11, "y"), (12, "z")], "program_id bigint, title string")
    links = frame(
        [(1, 12, 1), (1, 10, 2), (1, 11, 3), (1, 11, 3), (2, 99, 1), (None, 10, 1)],
        "content_id bigint, program_id bigint, ord int",
    )
    result = ops.linked_programs(content, links, programs, page_size=2)
    flat = {
        (row.content_id, row.page): [(p.ord, p.program_id, p.title) for p in row.programs]
        for row in result.collect()
    }
    assert flat == {
        (1, 0): [(1, 12, "z"), (2, 10, "x")],
        (1, 1): [(3, 11, "y")],
        (2, 0): [],
        (3, 0): [],
    }


def test_links_at_one_position_are_paged(spark):
    content = spark.createDataFrame([(1,)], "content_id bigint")
    numbers = spark.range(5000).select(F.col("id").alias("program_id"))
    links = numbers.select(F.lit(1).alias("content_id"), "program_id", F.lit(1).alias("ord"))
    pages = ops.linked_programs(content, links, numbers, page_size=100).collect()
    assert {row.page: [p.program_id for p in row.programs] for row in pages} == {
        page: list(range(100 * page, 100 * page + 100)) for page in range(50)
    }


def test_expand_batch(frame):
    df = frame([(1, 2), (2, 0), (3, None)], "blogger_id bigint, k int")
    assert rows_of(ops.expand_batch(df, df.k).select("blogger_id", "slot")) == [(1, 1), (1, 2)]
    assert ops.expand_batch(df, 3).count() == 9
    assert ops.expand_batch(df, 0).count() == 0

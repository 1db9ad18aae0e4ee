"""Related items by neighbours in MinHash orders: exact where all are compared, recall where not."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from airloom import operators as ops
from airloom.operators import similar
from tests.conftest import rows_of
from tests.test_tags import best_related, clean, random_items

DDL = "item_id bigint, tags array<string>"


def dense_items(count, width, tags=30):
    rng = random.Random(count + width)
    pool = [f"t{number:02}" for number in range(tags)]
    return [(number, rng.sample(pool, width)) for number in range(count)]


@pytest.mark.parametrize(("m", "min_sim"), [(1, 0.0), (3, 0.0), (4, 0.5), (2, 1.0), (300, 0.3)])
def test_one_order_compared_whole_equals_brute_force(frame, m, min_sim):
    rows = random_items(m, 90)
    found = ops.similar_items(frame(rows, DDL), m, min_sim, trees=1, depth=2, reach=len(rows))
    assert sorted(map(tuple, found.collect())) == best_related([(i, clean(t)) for i, t in rows if clean(t)], m, min_sim)


def test_result_does_not_depend_on_chunks_or_partitions(spark, frame):
    rows = dense_items(150, 5)
    results = [
        rows_of(ops.similar_items(frame(rows, DDL), 4, trees=4, reach=3, chunk=chunk)) for chunk in (1, 2, 7, 1000)
    ]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        results.append(rows_of(ops.similar_items(frame(rows[::-1], DDL), 4, trees=4, reach=3)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] and all(result == results[0] for result in results)


@pytest.mark.parametrize("width", [8, 12])
def test_recall_on_dense_tags(frame, width):
    rows = dense_items(1000, width)
    sets = {number: set(tags) for number, tags in rows}
    found = {}
    for row in ops.similar_items(frame(rows, DDL), 5, 0.3).collect():
        a, b = sets[row.item_id], sets[row.related_item_id]
        assert row.similarity == len(a & b) / len(a | b) >= 0.3
        found[row.item_id, row.rank] = row.similarity
    exact = best_related(rows, 5, 0.3)
    assert sum(found.get((a, rank)) == s for a, rank, _, s in exact) >= 0.9 * len(exact)


def test_comparisons_grow_with_the_sets_whatever_the_tags(frame):
    # Every set has the first two tags, and each pair of sets shares them.
    rows = [(n, ["always", "ever", f"own{n}"]) for n in range(400)]
    sets = frame(rows, DDL).select(F.sort_array("tags").alias("_set"), F.col("item_id").alias("_first"))
    trees, reach = 3, 5
    for chunk in (4, 64, 1000):
        placed = similar._in_places(sets, trees, 4)
        places = [(row["_tree"], row["_at"]) for row in placed.collect()]
        assert sorted(places) == [(tree, at) for tree in range(trees) for at in range(400)]
        pairs = similar._neighbours(placed, reach, chunk)
        assert pairs.count() == trees * (400 * reach - reach * (reach + 1) // 2)


def test_items_of_one_set_find_each_other(frame):
    rows = [(n, ["hot", "same"]) for n in range(0, 90, 3)] + [(n, ["hot", f"x{n}"]) for n in range(1, 60, 3)]
    best = ops.similar_items(frame(rows, DDL), 3, 0.9).where("item_id = 0 OR item_id = 87").collect()
    assert sorted(map(tuple, best)) == [
        (0, 1, 3, 1.0), (0, 2, 6, 1.0), (0, 3, 9, 1.0), (87, 1, 0, 1.0), (87, 2, 3, 1.0), (87, 3, 6, 1.0),
    ]


def test_nulls_and_empty_tables(frame):
    rows = [(1, None), (2, []), (3, [None]), (4, ["a", None]), (5, ["a", "a"]), (6, ["b"])]
    assert rows_of(ops.similar_items(frame(rows, DDL), 2)) == [(4, 1, 5, 1.0), (5, 1, 4, 1.0)]
    assert ops.similar_items(frame(rows, DDL).where("item_id < 4"), 2).count() == 0


def test_wrong_parameters(frame):
    items = frame([(1, ["a"])], DDL)
    with pytest.raises(ValueError, match="between 0 and 1"):
        ops.similar_items(items, 1, 1.5)
    for name in ("trees", "depth", "reach", "chunk"):
        with pytest.raises(ValueError, match="at least 1"):
            ops.similar_items(items, 1, **{name: 0})

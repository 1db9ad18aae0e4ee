"""Search by feature vectors against all products."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from airloom.llm import related
from airloom.llm.oracles import ORACLES
from airloom.llm.queries import QUERIES
from airloom.plans import standins

KIND = "item_id long, features array<double>"
WANTED = "item_id % 2 = 0"


def plain(rows, m, steps=64):
    """The best of every wanted row, by all products of whole numbers."""
    known = [
        (place, item, [math.floor(x * steps) for x in vector])
        for place, (item, vector) in enumerate(rows)
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector)
    ]
    found = []
    for place, item, vector in known:
        if item is not None and item % 2 == 0:
            scores = [
                (-min(sum(x * y for x, y in zip(vector, other, strict=False)), 2**63 - 1), other_item is None, other_item or 0, other_item)
                for other_place, other_item, other in known
                if other_place != place
            ]
            found += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:m], 1)]
    return sorted(found, key=str)


def searched(df, m=5, **options):
    return sorted((tuple(r) for r in related.related_by_features(df, WANTED, m, **options).collect()), key=str)


@pytest.mark.parametrize("block", [7, 40, 10_000])
def test_equals_all_products(spark, block):
    rng = np.random.default_rng(block)
    scale = rng.exponential(1.0, 300)[:, None]  # very different lengths, few directions
    vectors = (rng.standard_normal((300, 3)) @ rng.standard_normal((3, 12)) + 0.1 * rng.standard_normal((300, 12))) * scale
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    assert searched(spark.createDataFrame(rows, KIND).repartition(5), block=block) == plain(rows, 5)


def test_long_vectors_shut_blocks_of_short_ones_out(spark, monkeypatch):
    """Only the first blocks can reach what has been found: the others are never compared."""
    rows = [(i, [100.0 if i < 40 else 0.01, float(i % 3)]) for i in range(400)]
    seen = []
    real = related.written
    monkeypatch.setattr(related, "written", lambda df, purpose, **o: seen.append((purpose, real(df, purpose, **o))) or seen[-1][1])
    df = spark.createDataFrame(rows, KIND).repartition(4)
    wanted = F.col("item_id") == 2
    found = related.related_by_features(df, wanted, 5, block=20).collect()
    pairs = [frame.count() for purpose, frame in seen if purpose == "block-pairs"]
    assert len(found) == 5 and sum(pairs) < 8 and pairs[-1] == 0


def test_odd_rows_ties_and_repeats(spark):
    rows = [
        (2, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [3.0, 0.0]), (4, []), (4, None), (6, [None, 1.0]), (6, [math.nan, 1.0]),
        (8, [math.inf, 1.0]), (None, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0, 50.0]), (3, [1.0, 2.0]),
        (5, [1.0, 2.0]), (10, [0.0, 0.0]), (7, [-1.0, -2.0]), (12, [0.0, 0.0, 1.0]),
    ]
    for block in (3, 1000):
        assert searched(spark.createDataFrame(rows, KIND), m=4, block=block) == plain(rows, 4)


def test_a_third_of_equal_vectors_spreads_over_blocks(spark):
    rng = random.Random(3)
    rows = [(i, [0.5, 0.5] if i % 3 else [rng.random(), rng.random()]) for i in range(600)]
    df = spark.createDataFrame(rows, KIND).repartition(4)
    vectors = related._vectors(df, WANTED, "item_id", "features", 64)
    sizes = [r["count"] for r in related._by_length(vectors, 600, 50).groupBy("_block").count().collect()]
    assert max(sizes) < 120 and sum(sizes) == 600
    assert searched(df, block=50) == plain(rows, 5)


def test_numbers_beyond_doubles_are_exact(spark):
    rows = [(i, [float(2**40 + i), 3.0, float(i % 5)]) for i in range(30)]
    assert searched(spark.createDataFrame(rows, KIND), m=3, block=8) == plain(rows, 3)
    rows = [(i, [float(2**23 + i), 3.0, float(i % 5)]) for i in range(30)]
    assert searched(spark.createDataFrame(rows, KIND), m=3, block=8) == plain(rows, 3)


def test_text_ids_empty_tables_and_other_columns(spark):
    rows = [("b", [1.0]), ("a", [1.0]), (None, [1.0]), ("c", [2.0])]
    df = spark.createDataFrame(rows, "item_id string, features array<float>")
    df = df.withColumns({n: F.lit("x") for n in ("_key", "_item", "_block", "rank", "score", "_wanted", "related_item_id")})
    found = related.related_by_features(df, F.col("item_id") == "c", 3).collect()
    assert sorted(tuple(r) for r in found) == [("c", 1, "a", 128 * 64), ("c", 2, "b", 128 * 64), ("c", 3, None, 128 * 64)]
    assert related.related_by_features(df, F.lit(False)).count() == 0
    assert related.related_by_features(df.limit(0), F.lit(True)).count() == 0
    assert related.related_by_features(df.where("item_id = 'c'"), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        related.related_by_features(df, F.lit(True), 0)


def test_catalogue_items_by_shared_tags(spark):
    """With a coordinate of 1 for each tag an entry has, the score counts the tags shared."""
    programs = standins.programs(spark, "/root/testdata/sf0.001").select("program_id", "tags")
    tags = sorted({tag for r in programs.collect() for tag in r.tags})
    marks = F.array(*(F.array_contains("tags", tag).cast("int") for tag in tags))
    items = programs.withColumn("features", marks)
    found = related.related_by_features(items, F.col("program_id") <= 20, 3, "program_id", steps=1).collect()
    sets = {r.program_id: set(r.tags) for r in programs.collect()}
    assert len(found) == 3 * sum(p <= 20 for p in sets)
    for r in found:
        assert r.score == len(sets[r.program_id] & sets[r.related_program_id])
        better = [p for p in sets if p != r.program_id and (len(sets[p] & sets[r.program_id]), -p) > (r.score, -r.related_program_id)]
        assert len(better) == r.rank - 1


def test_query_equals_sql_on_odd_rows(spark, tmp_path):
    rows = [(i, [float(i % 7), 0.25, -1.5], 0) for i in range(100)]
    rows += [(20, None, 1), (40, [None], 1), (60, [math.nan], None), (None, [1.0], 1), (20, [0.5], 1), (0, [], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(
        f"{tmp_path}/embeddings.parquet"
    )
    found = sorted((tuple(r) for r in QUERIES["op11_related_by_features"](spark, str(tmp_path)).collect()), key=str)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert found == sorted(duck.sql(ORACLES["op11_related_by_features"]).fetchall(), key=str) and found

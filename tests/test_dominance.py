from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airloom.operators import dominance_counts
from airloom.operators.dominance import below_both

KIND = "id int, price double, size int"


def plain(rows):
    return sorted(
        (i, p, s, None if None in (p, s) else sum(None not in (q, t) and q < p and t > s for _, q, t in rows))
        for i, p, s in rows
    )


@pytest.mark.parametrize("seed", range(3))
def test_ranks_below_both(seed):
    rng = np.random.default_rng(seed)
    for n in (0, 1, 2, 7, 64, 65, 300):
        u, v = rng.integers(0, max(1, n // 3), n), rng.permutation(n)
        assert below_both(u, v).tolist() == [int(((u < u[i]) & (v < v[i])).sum()) for i in range(n)]


@pytest.mark.parametrize("stripe", [1, 10, 64, 100_000])
def test_equals_all_pairs(spark, stripe):
    rng = random.Random(stripe)
    rows = [(i, rng.choice([None, *map(float, range(12))]), rng.choice([None, *range(9)])) for i in range(400)]
    rows += [(i, 5.0, 5) for i in range(400, 560)]  # a group of ties
    df = spark.createDataFrame(rows, KIND).repartition(5)
    found = dominance_counts(df, "price", "size", stripe)
    assert found.columns == ["id", "price", "size", "beaten_by"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(plain(rows), key=str)


def test_plan_has_no_pairs_and_names_may_clash(spark):
    df = spark.createDataFrame([(1, 1.0, 5), (2, 2.0, 4), (2, 2.0, 4)], KIND)
    df = df.withColumns({n: F.lit("x") for n in ("_key", "_row", "_x", "_n", "_before", "beaten_by", "_slice", "_a")})
    found = dominance_counts(df, "price", "size")
    assert sorted((r.id, r.beaten_by) for r in found.collect()) == [(1, 0), (2, 1), (2, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert dominance_counts(df.limit(0), "price", "size").count() == 0
    with pytest.raises(ValueError):
        dominance_counts(df, "price", "size", 0)

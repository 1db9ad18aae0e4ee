from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from airloom import operators as ops
from tests.conftest import rows_of

SCORES = [(1, "a", 5.0), (2, "a", 7.0), (3, "a", 5.0), (4, "a", None), (5, "b", 1.0)]


@pytest.fixture
def scores(frame):
    return frame(SCORES, "key bigint, grp string, value double")


def test_ranking_breaks_ties_by_key_and_puts_null_last(scores):
    best = ops.effect_ranking(scores, "key", F.sum("value"), 2)
    assert rows_of(best) == [(1, 2, 7.0), (2, 1, 5.0)]
    everything = ops.effect_ranking(scores, "key", F.sum("value"), 10)
    assert rows_of(everything)[-1] == (5, 4, None)


def test_ranking_by_group_with_small_groups(scores):
    best = ops.ranking_by_group(scores, "grp", [F.desc_nulls_last("value"), F.asc("key")], 3)
    assert rows_of(best.select("grp", "rank", "key")) == [
        ("a", 1, 2),
        ("a", 2, 1),
        ("a", 3, 3),
        ("b", 1, 5),
    ]


def test_topics_count_once_and_k_is_checked(frame):
    df = frame(
        [(1, "d1", "x", 1.0), (1, "d1", "x", 9.0), (1, "d1", "y", 9.0), (1, "d1", "z", 3.0)],
        "blogger bigint, day string, topic string, score double",
    )
    by = ["blogger", "day"]
    two = ops.topic_suggestions(df, by, "topic", "score", 2)
    assert rows_of(two.select("rank", "topic", "score")) == [(1, "x", 9.0), (2, "y", 9.0)]
    for k in (1, 3):
        assert ops.topic_suggestions(df, by, "topic", "score", k).count() == k
    for k in (0, 4):
        with pytest.raises(ValueError):
            ops.topic_suggestions(df, by, "topic", "score", k)


def test_drilldown_has_both_levels(scores):
    result = ops.drilldown(
        scores, "grp", "key", {"n": ("count", "value"), "sum": ("sum", "value"), "low": ("min", "value")}
    )
    assert rows_of(result.where("level = 'grp'")) == [
        ("grp", "a", None, 3, 17.0, 5.0),
        ("grp", "b", None, 1, 1.0, 1.0),
    ]
    assert result.where("level = 'key'").count() == 5
    with pytest.raises(ValueError):
        ops.drilldown(scores, "grp", "key", {"x": ("median", "value")})
    means = ops.drilldown(scores, "grp", "key", {"mean": ("avg", "value")})
    assert rows_of(means.where("level = 'grp'")) == [("grp", "a", None, 17 / 3), ("grp", "b", None, 1.0)]

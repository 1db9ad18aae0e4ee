from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from airloom import operators as ops
from tests.conftest import rows_of


@pytest.fixture
def catalog(frame):
    return frame(
        [
            (1, "100% Real", "film"),
            (2, "snake_case", "film"),
            (3, "Dot. Com", "show"),
            (4, "蓝色星球", "show"),
            (5, None, "film"),
            (6, "ÉCOLE", None),
            (7, "plain", "film"),
        ],
        "program_id bigint, title string, category string",
    )


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("%", [1]),
        ("_", [2]),
        (".", [3]),
        ("REAL", [1]),
        ("星球", [4]),
        ("école", [6]),
        ("", [1, 2, 3, 4, 5, 6, 7]),
        ("film", [1, 2, 5, 7]),
        ("nothing", []),
    ],
)
def test_search_is_literal_and_ignores_case(catalog, text, found):
    result = ops.search_filter(catalog, text, ["title", "category"])
    assert sorted(row.program_id for row in result.collect()) == found


def test_facets_narrow_the_search(catalog):
    result = ops.search_filter(catalog, "a", ["title"], {"category": "film", "program_id": None})
    assert sorted(row.program_id for row in result.collect()) == [1, 2, 7]
    with pytest.raises(ValueError):
        ops.search_filter(catalog, "a", [])


def test_page_carries_the_full_count(catalog):
    page = ops.catalog_page(catalog.select("program_id"), [F.desc("program_id")], 2)
    assert rows_of(page) == [(6, 7), (7, 7)]
    assert ops.catalog_page(catalog.where("false"), ["program_id"], 2).collect() == []
    assert len(ops.catalog_page(catalog, ["program_id"], 50).collect()) == 7
    with pytest.raises(ValueError):
        ops.catalog_page(catalog, ["program_id"], 0)


def test_facet_counts_keep_null_values(catalog):
    counts = ops.facet_counts(catalog.where("program_id > 5"), ["category", "program_id"])
    assert rows_of(counts) == [
        ("category", "film", 1),
        ("category", None, 1),
        ("program_id", "6", 1),
        ("program_id", "7", 1),
    ]


def test_missing_status_is_not_the_total(frame):
    df = frame([("a",), ("a",), ("b",), (None,)], "status string")
    counts = ops.status_tab_counts(df, "status")
    assert rows_of(counts) == [
        ("all", None, 4),
        ("status", "a", 2),
        ("status", "b", 1),
        ("status", None, 1),
    ]
    total = {row.tab: 0 for row in counts.collect()}
    for row in counts.collect():
        total[row.tab] += row.n
    assert total["all"] == total["status"]

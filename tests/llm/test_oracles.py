"""The corpus queries that SQL can express, against DuckDB, on the driver's tables and on odd rows."""

from __future__ import annotations

import duckdb
import pytest

from airloom.llm.oracles import ORACLES
from airloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
LONG = "a tale of words that goes on and on without an end " * 4000
PLAIN = " ".join(f"word{i}" for i in range(60))
SHARED = " ".join(f"leak{i}" for i in range(20))
NOTICE = "Released under the MIT License."
GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without "
    "fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear "
    "in all copies."
)
ROWS = [
    (1, PLAIN, "en", "a"), (2, PLAIN, "en", "a"), (2, PLAIN, "en", "a"), (3, "", "en", None),
    (4, None, None, None), (None, PLAIN, "en", "a"), (None, None, "de", "a"), (5, LONG, None, "b"),
    (6, SHARED, "en", "b"), (7, f"{PLAIN} {SHARED.upper()}!", "en", "c"), (8, "leak1 leak2", "en", "c"),
    (9, " \t\n\n", "en", "c"), (10, f"{PLAIN}\n{PLAIN}\n###$$$ é ü 中文", "zh", "Ä"), (11, "short item", "en", ""),
    (12, f"{PLAIN}\n{NOTICE}\nmore.", "en", "c"), (13, GRANT, "en", "c"), (14, NOTICE + " " + NOTICE, "en", "d"),
]
BENCHMARK = [
    (1, SHARED), (1, SHARED), (2, "short item"), (3, None), (4, ""), (None, "word3 word4"),
    (5, "unseen term here"), (6, SHARED + " other"),
]
VECTORS = [(0, [1.0, 2.0], 0), (20, [0.5], 1), (20, [0.5], None), (None, [3.0, 1.0], 0), (1, None, 1), (40, [None], 1)]
TABLES = ("documents", "benchmark", "embeddings")
#: Queries that do not return a row for each document: three of three others each here.
OTHER = {"op11_related_by_features": 9}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    documents = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    documents.selectExpr("*", "cast(length(text) AS bigint) AS n_chars").coalesce(2).write.parquet(
        f"{folder}/documents.parquet"
    )
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int").write.parquet(
        f"{folder}/embeddings.parquet"
    )
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in TABLES:
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def compare(spark, name, folder, pattern):
    result = QUERIES[name](spark, folder)
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet{pattern}')"
        )
    relation = connection.sql(ORACLES[name])
    assert sorted(result.columns) == sorted(relation.columns)
    key = lambda row: [(value is None, value) for value in row]
    actual = sorted((tuple(row) for row in result.collect()), key=key)
    assert actual == sorted(relation.select(", ".join(result.columns)).fetchall(), key=key)
    return actual


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_driver_tables(spark, name):
    assert compare(spark, name, FOLDER, "")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_odd_rows(spark, odd, name):
    assert len(compare(spark, name, odd, "/*.parquet")) == OTHER.get(name, len(ROWS))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0

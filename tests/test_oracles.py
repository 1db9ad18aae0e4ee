"""Every registered query against its SQL counterpart, on all rows."""

from __future__ import annotations

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from airloom.plans.queries import QUERIES
from airloom.sources import SCHEMAS

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
KINDS = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in SCHEMAS:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')"
        )
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    result = queries()[name](spark, FOLDER)
    relation = duck.sql(oracle_sql()[name])
    columns = sorted(result.columns)
    assert columns == sorted(relation.columns)
    kinds = dict(zip(relation.columns, map(str, relation.types), strict=True))
    assert {c: KINDS[kinds[c]] for c in columns} == dict(result.dtypes)

    def key(row):
        return [(value is None, value) for value in row]

    actual = sorted((tuple(row[c] for c in columns) for row in result.collect()), key=key)
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = sorted(relation.select(quoted).fetchall(), key=key)
    assert len(actual) == len(expected)
    different = [pair for pair in zip(actual, expected, strict=True) if pair[0] != pair[1]]
    assert different == [], different[:3]
    assert actual or name == "source_readiness_missing"


def test_entry_has_a_row_per_stage(spark):
    assert entry(spark).count() == 4

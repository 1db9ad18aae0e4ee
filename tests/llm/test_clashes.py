"""Columns of any name, documents without ids, and empty tables, for operators and queries that rewrite or predict."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from airloom.llm import paragraphs, passages
from airloom.llm.queries import QUERIES

NAMES = ("_id", "_removed", "_cuts", "_key", "_row", "_script", "start", "paragraph", "removed")
KIND = "content_id long, script string"


def texts(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


@pytest.fixture
def content(spark):
    rng = random.Random(1)
    shared = texts(rng, 60)
    rows = [(1, f"{texts(rng, 30)}\n{shared}"), (2, f"{shared}\n{texts(rng, 30)}"), (None, shared), (4, None), (5, "")]
    return spark.createDataFrame(rows, KIND).withColumns({name: F.lit(name) for name in NAMES})


@pytest.mark.parametrize(
    ("find", "cut"),
    [
        (paragraphs.repeated_paragraphs, paragraphs.without_repeats),
        (passages.repeated_passages, passages.without_passages),
    ],
)
def test_scripts_are_cut_whatever_the_columns_are_called(content, find, cut):
    found = cut(content, find(content))
    assert found.columns == content.columns
    rows = {r.content_id: r for r in found.collect()}
    assert all(r[name] == name for r in rows.values() for name in NAMES)
    before = {r.content_id: r.script for r in content.collect()}
    assert rows[None].script == before[None] and rows[4].script is None and rows[5].script == ""
    lengths = sorted(len(rows[i].script.split()) for i in (1, 2))
    assert lengths in ([30, 90], [30, 30])  # the first place may be that of the row without an id
    assert find(content.limit(0)).count() == 0 and cut(content.limit(0), find(content.limit(0))).count() == 0


@pytest.mark.parametrize("name", ["op8_language_mixture", "op10_quality_votes"])
def test_documents_without_an_id_are_not_held_out(spark, tmp_path, name):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    assert found.where("held_out IS NULL").count() == 0
    assert found.where("doc_id IS NULL AND NOT held_out").count() == 3 and found.where("held_out").count() > 10

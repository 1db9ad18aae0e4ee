from __future__ import annotations

from types import SimpleNamespace

import pytest

from airloom.session import shared_folder
from airloom.sources import SCHEMAS, load_table, load_tables


def fake_session(master, root):
    return SimpleNamespace(
        conf=SimpleNamespace(
            get=lambda name, default=None: {"spark.checkpoint.dir": root, "spark.sql.warehouse.dir": "/warehouse/"}[name]
            or default
        ),
        sparkContext=SimpleNamespace(master=master),
    )


def test_shared_folder_comes_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert first.startswith(f"{root}/x-") and first != second


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(fake_session("yarn", None), "x")
    assert shared_folder(fake_session("yarn", "hdfs:///work/"), "x").startswith("hdfs:///work/x-")
    assert shared_folder(fake_session("local[2]", None), "x").startswith("/warehouse/shared/x-")


def test_tables_are_read_with_their_declared_schema(spark):
    tables = load_tables(spark, "/root/testdata/sf0.001/", ["events", "labels"])
    assert dict(tables["events"].dtypes)["ts"] == "timestamp_ntz"
    assert tables["labels"].columns == ["doc_id", "quality", "toxic"]
    assert len(SCHEMAS) == 14
    with pytest.raises(ValueError, match="unknown table"):
        load_table(spark, "/root/testdata/sf0.001", "nothing")

"""Readers for the driver's parquet tables, with declared schemas (nothing is inferred)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

SCHEMAS: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

def _schema(name: str) -> str:
    if name not in SCHEMAS:
        raise ValueError(f"unknown table {name!r}; known: {', '.join(sorted(SCHEMAS))}")
    return SCHEMAS[name]


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table: ``<folder>/<name>.parquet``, a file or a folder of files."""
    return spark.read.schema(_schema(name)).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def load_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Several tables by name. Reading is lazy, so unused ones cost nothing."""
    return {name: load_table(spark, folder, name) for name in names}


def stream_table(
    spark: SparkSession, folder: str, name: str, max_files: int | None = None
) -> DataFrame:
    """The same table as a stream, with the same schema.

    ``max_files`` bounds the files of one micro-batch, and with them its memory.
    """
    reader = spark.readStream.schema(_schema(name)).option("pathGlobFilter", f"{name}.parquet")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)

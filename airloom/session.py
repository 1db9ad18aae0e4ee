"""Session settings for tests and benchmarks, and the shared working folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(
    master: str = "local[8]", name: str = "airloom", **conf: object
) -> SparkSession:
    """A local session. On a cluster, use the session that the cluster provides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # Recording the Python call site of every column costs more than planning does.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key: str(value) for key, value in conf.items()})
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir`` that every executor can reach.

    A session of one machine may go without that setting and takes its warehouse folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: no lineage, and its true size is known."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)

"""Where live results go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def status_log(
    folder: str,
    key: str,
    ts: str = "ts",
    event_id: str = "event_id",
    status: str = "status",
    block: int = 100,
) -> Callable[[DataFrame, int], None]:
    """Upsert by log: each micro-batch writes its changed keys to a folder of its own.

    A micro-batch that is run again after a failure replaces its folder, so nothing is counted
    twice. :func:`latest_status` reads the newest row per key.

    The log does not grow with the changes: ``block`` micro-batches share a block folder, and the
    first of a block writes the newest row per key of the block before as its base. The block
    before that is then emptied, as all of it lives on in two bases; one block back is kept for
    readers under way. Each step reads only blocks that it does not write, so it can be repeated.
    """
    if block < 1:
        raise ValueError("a block has at least one micro-batch")
    root = folder.rstrip("/")

    def write(batch: DataFrame, epoch: int) -> None:
        number, place = divmod(epoch, block)
        if place == 0 and number > 0:
            spark = batch.sparkSession
            before = spark.read.schema(batch.schema).option("recursiveFileLookup", "true")
            base = _newest(before.parquet(f"{root}/block{number - 1}"), key, ts, event_id, status)
            base.write.mode("overwrite").parquet(f"{root}/block{number}/base")
            if number > 1:
                nothing = spark.createDataFrame([], batch.schema)
                nothing.write.mode("overwrite").parquet(f"{root}/block{number - 2}")
        batch.write.mode("overwrite").parquet(f"{root}/block{number}/epoch{epoch}")

    return write


def _newest(log: DataFrame, key: str, ts: str, event_id: str, status: str) -> DataFrame:
    newest = F.max(F.struct(ts, event_id, status))
    return log.groupBy(key).agg(newest.alias("_newest")).select(key, "_newest.*")


def latest_status(
    spark: SparkSession,
    folder: str,
    key: str,
    ts: str = "ts",
    event_id: str = "event_id",
    status: str = "status",
) -> DataFrame:
    """The newest row per key of a :func:`status_log`."""
    log = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    return _newest(log, key, ts, event_id, status)


def run_to_end(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process what is there now and stop; a later run goes on from the same checkpoint."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

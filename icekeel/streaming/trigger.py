"""Cycles driven by a Structured Streaming trigger instead of a loop of the driver's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery


def every(spark: SparkSession, interval: str, cycle: Callable[[], object], checkpoint: str) -> StreamingQuery:
    """Runs cycle() at each trigger, never two at a time; the first at once. interval is a Spark interval such as "5 minutes"."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.trigger(processingTime=interval).option("checkpointLocation", checkpoint).foreachBatch(lambda _, __: cycle()).start()

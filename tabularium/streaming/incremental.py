"""Progressive processing of what is pending: a Structured Streaming job that takes what is there and ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new(spark: SparkSession, folder: str, schema, step: Callable[[DataFrame, int], None], state: str) -> None:
    """Give every Parquet file of folder that the state folder doesn't know yet to step(batch, number), then end."""
    stream = spark.readStream.schema(schema).parquet(folder)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

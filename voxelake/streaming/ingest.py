"""Streaming ingest: deduplication within a watermark, and appends by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest
from ..session import shared_path


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Rows of a stream, each key once while the watermark holds it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def append_batches(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Every micro-batch is deduplicated, classified against the store and its new instances written."""

    def step(batch: DataFrame, number: int) -> None:
        rows = ingest.classify(ingest.winners(batch, keys, order), read(), keys)
        write(rows.filter("status = 'new'").drop("status"), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """All rows that a finite stream gives, through a table in the shared folder."""
    path = shared_path(spark, name)
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)

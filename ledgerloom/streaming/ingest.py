"""New files taken in as they appear, each content once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.sources.catalog import content_hash, pending


def watch(spark: SparkSession, folder: str, checkpoint: str, manifest: Callable[[], DataFrame], take: Callable[[DataFrame, int], None], version: str = "2.4") -> StreamingQuery:
    """Hand files that the manifest doesn't know yet to ``take``, batch by batch, until those there are done."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def batch(df: DataFrame, number: int) -> None:
        take(pending(content_hash(df), manifest(), version), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

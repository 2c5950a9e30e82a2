"""Incremental ingest: new packet files as a stream that runs until nothing is left, with exactly-once output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ingest(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, progress: str, files_per_batch: int = 1000) -> int:
    """Runs `transform` over the Parquet files that `progress` has not seen, appends the rows to `sink`; the number of batches that had rows.

    transform must be row-wise or key its work by file: each batch sees new files only.
    """
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = transform(new).writeStream.format("parquet").option("path", sink).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(1 for p in query.recentProgress if p["numInputRows"])

"""Incremental ingest as Structured Streaming.

The checkpoint remembers which files were read, so nothing has to poll for
them; upserts keep their state in the target table and not in the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from stratalake.functions.columns import cols
from stratalake.sources.tables import Lake


def stream_files(
    spark: SparkSession,
    path: str,
    schema: str | StructType,
    file_format: str = "parquet",
    pattern: str = "*",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Files that appear below ``path``, each read once."""
    reader = spark.readStream.format(file_format).schema(schema).option("pathGlobFilter", pattern)
    if file_format == "csv":
        reader = reader.option("header", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def with_event_time(stream: DataFrame, column: str, lateness: str) -> DataFrame:
    """Declare event time; un-zoned timestamps are first read in the session's zone."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def first_per_key(stream: DataFrame, keys: Sequence[str], column: str, lateness: str) -> DataFrame:
    """The first row per key among those arriving within ``lateness``; for append-only sinks."""
    return with_event_time(stream, column, lateness).dropDuplicatesWithinWatermark(list(keys))


def merge_stream(
    stream: DataFrame,
    lake: Lake,
    table: str,
    keys: Sequence[str],
    order_by: Sequence[str],
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    partition_by: Sequence[str] = (),
    buckets: int | None = None,
) -> StreamingQuery:
    """Upsert all available data, one micro-batch after the other, then stop.

    The greatest row by ``order_by`` stays, so a batch that is repeated after a
    failure, and several streams into one table, end in the same rows. With
    ``buckets`` a new table is stored by the hash of its keys, and a micro-batch
    rewrites the buckets of its keys and not the whole table.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        lake.merge(table, transform(batch), keys, order_by, partition_by, newest_wins=True, buckets=buckets)

    return (
        stream.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_stream(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Append all available data as Parquet, then stop."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.outputMode("append").start(path)

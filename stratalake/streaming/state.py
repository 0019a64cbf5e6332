"""Keyed stream state: first rows per key beside the rows that came too late, and sources that fell silent."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratalake.functions.columns import col, require_columns
from stratalake.session import path_exists
from stratalake.streaming.ingest import append_stream, first_per_key, with_event_time


def split_late(
    stream: DataFrame, column: str, lateness: timedelta, on_time: str, late: str, checkpoint: str
) -> StreamingQuery:
    """Write rows that are not too late to ``on_time`` and the others to ``late``; all available data, then stop.

    A row is late if its time lies more than ``lateness`` before the highest time of earlier batches; so is a row without a
    time. That highest time is kept beside the checkpoint, one row per batch. Every batch writes folders of its own
    number, so a batch that is repeated after a failure replaces what it had written.
    """
    require_columns(stream, [column])
    highs = f"{checkpoint.rstrip('/')}-highs"

    def split(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        high = None
        if path_exists(spark, highs):
            seen = spark.read.schema("batch long, high timestamp").option("recursiveFileLookup", "true").parquet(highs)
            high = seen.where(F.col("batch") < number).agg(F.max("high")).first()[0]
        time = col(column).cast("timestamp")
        rows = batch.withColumn("__late", time.isNull() if high is None else time.isNull() | (time < F.lit(high) - F.lit(lateness)))
        # Both parts and the new high come from one reading of the batch.
        rows.persist()
        try:
            for path, part in ((on_time, ~F.col("__late")), (late, F.col("__late"))):
                rows.where(part).drop("__late").write.mode("overwrite").parquet(f"{path}/{number:012d}")
            top = rows.where(time.isNotNull()).agg(F.max(time).alias("high")).select(F.lit(number).cast("long").alias("batch"), "high")
            top.write.mode("overwrite").parquet(f"{highs}/{number:012d}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_and_late(
    stream: DataFrame, keys: Sequence[str], column: str, lateness: timedelta, folder: str, max_files: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Feed all available data into two tables below ``folder``: the first row per key, and the rows that came too late.

    Every row of the stream is the first of its key, a repetition of it within ``lateness``, or in the table of late rows:
    the keyed state drops no row unseen. May be called again when more data has arrived; it goes on from its checkpoints.
    """
    spark = stream.sparkSession
    split_late(stream, column, lateness, f"{folder}/on-time", f"{folder}/late", f"{folder}/split").awaitTermination()
    reader = spark.readStream.schema(stream.schema).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    words = f"{int(lateness.total_seconds())} seconds"
    kept = first_per_key(reader.parquet(f"{folder}/on-time"), keys, column, words)
    append_stream(kept, f"{folder}/first", f"{folder}/dedup").awaitTermination()
    read = spark.read.option("recursiveFileLookup", "true")
    return read.schema(kept.schema).parquet(f"{folder}/first"), read.schema(stream.schema).parquet(f"{folder}/late")


_STATE = "last long, told boolean"


def silences(stream: DataFrame, key: str, column: str, limit: timedelta, lateness: timedelta) -> DataFrame:
    """Each time a key sends nothing for longer than ``limit``: key, ``last_seen``, and ``silent_from``, when the limit was over.

    A timer per key fires as soon as the stream's time (the highest seen, less ``lateness``) has passed the limit, whether or
    not the key ever sends again. A gap that is over before its timer could fire is told as well, so the rows do not
    depend on how the stream was cut into batches. The state is two values per key.
    """
    require_columns(stream, [key, column])
    timed = with_event_time(stream.select(key, column), column, f"{int(lateness.total_seconds())} seconds").where(col(column).isNotNull())
    timed = timed.withColumn("_micros", F.unix_micros(col(column)))
    wait = int(limit.total_seconds() * 1_000_000)
    out = T.StructType([T.StructField(key, stream.schema[key].dataType), T.StructField("_last", T.LongType())])

    def follow(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told = state.get if state.exists else (None, False)
        found = []
        if state.hasTimedOut:
            found, told = [last], True
        else:
            for time in sorted(int(t) for batch in batches for t in batch["_micros"]):
                if last is not None and time - last > wait and not told:
                    found.append(last)
                if last is None or time > last:
                    last, told = time, False
        state.update((last, told))
        if not told:
            state.setTimeoutTimestamp(max((last + wait) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: pd.Series([name[0]] * len(found), dtype=object), "_last": pd.Series(found, dtype="int64")})

    alerts = timed.groupBy(key).applyInPandasWithState(follow, out, T.StructType.fromDDL(_STATE), "append", GroupStateTimeout.EventTimeTimeout)
    return alerts.select(
        col(key), F.timestamp_micros("_last").alias("last_seen"), F.timestamp_micros(F.col("_last") + wait).alias("silent_from")
    )


def read_appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What a stream has appended to a folder so far."""
    return spark.read.schema(schema).parquet(path)

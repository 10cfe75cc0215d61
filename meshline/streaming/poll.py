"""Polled snapshots as streams: content-hash deduplication, upserts with first
and last sight, resolution by absence, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from meshline.operators.upsert import merge_create_match, resolve_stale
from meshline.sources.sinks import replace, settle


def new_content(polls: DataFrame, hash_column: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each content once within the watermark's delay: state is bounded by it."""
    return polls.withWatermark(time, delay).dropDuplicatesWithinWatermark([hash_column])


def merge_poll(state: DataFrame, batch: DataFrame, key: str = "composite_key") -> DataFrame:
    """One poll into the state: new keys are inserted, known ones only seen
    again, active ones that the poll lacks are resolved. The poll's time is its
    rows' `poll_timestamp`."""
    seen = batch.withColumn("last_seen_poll", F.col("poll_timestamp"))
    if "first_seen_poll" in state.columns:
        seen = seen.withColumn("first_seen_poll", F.col("poll_timestamp"))
    for column, kind in state.dtypes:
        if column not in seen.columns:
            seen = seen.withColumn(column, F.lit(None).cast(kind))
    merged = merge_create_match(state, seen.select(*state.columns), key, ["last_seen_poll"])
    at = batch.agg(F.max("poll_timestamp").alias("__poll"))
    known = merged.crossJoin(F.broadcast(at))
    return resolve_stale(known.where("__poll is not null"), F.col("__poll")).unionByName(known.where("__poll is null")).drop("__poll")


def keep_state(polls: DataFrame, path: str, key: str = "composite_key") -> DataStreamWriter:
    """A stream of polls kept as a state table at `path`, which must exist. A
    batch that runs again gives the same state."""

    def step(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            spark = batch.sparkSession
            settle(spark, path)
            replace(spark, merge_poll(spark.read.parquet(path), batch, key), path)

    return polls.writeStream.foreachBatch(step)


def windowed(events: DataFrame, time: str, size: str, by: list[str], aggregates: list, delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows with a watermark; late rows beyond it are dropped."""
    return events.withWatermark(time, delay).groupBy(F.window(time, size, slide) if slide else F.window(time, size), *by).agg(*aggregates)


def sessions(events: DataFrame, time: str, gap: str, by: list[str], aggregates: list, delay: str = "10 minutes") -> DataFrame:
    """Sessions that end after `gap` without an event."""
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap), *by).agg(*aggregates)


def run_until_empty(writer: DataStreamWriter, checkpoint: str) -> None:
    """Take all that is there in batches, then stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_complete(result: DataFrame, path: str, checkpoint: str) -> None:
    """Take all that a stream has and keep its whole aggregate as a table at
    `path`, windows that are still open included."""

    def step(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    run_until_empty(result.writeStream.outputMode("complete").foreachBatch(step), checkpoint)


def tolerant(readers: dict[str, Callable[[], DataFrame]]) -> DataFrame | None:
    """The union of the streams that can be opened."""
    from meshline.sources.realtime import read_all

    return read_all(readers, land=False)

"""Incremental runs as streams: only what is new is worked on, and results are merged by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from caseloom.functions.reports import content_key
from caseloom.sources.sinks import upsert


def first_of_each(stream: DataFrame, key: str, event_time: str, lateness: str = "1 hour") -> DataFrame:
    """Rows whose key did not come before within the watermark."""
    return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, event_time: str, every: str, *by: str, lateness: str = "1 hour") -> DataFrame:
    """Rows for each window and group, final once the watermark has passed."""
    w = F.window(event_time, every)
    return stream.withWatermark(event_time, lateness).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def cached(stream: DataFrame, path: str, checkpoints: str, work: Callable[[DataFrame], DataFrame], parts: list[str], available_now: bool = True) -> StreamingQuery:
    """Answer each row once: rows are keyed by the hash of ``parts``, keys already in the table at ``path`` are skipped.

    ``work`` turns pending rows into (hash, ..., ts); each micro-batch is merged
    by key, so a batch that runs twice leaves the same table.
    """
    from caseloom.operators.joins import pending
    from caseloom.sources.versions import read_table

    def merge(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("hash", content_key(*parts)).dropDuplicates(["hash"])
        spark = batch.sparkSession
        there = read_table(spark, path)
        fresh = rows if there is None else pending(rows, there, "hash")
        upsert(spark, path, work(fresh), "hash", "ts")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoints)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

"""Incremental forms of counting and first-seen de-duplication, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """window_start, *keys, n; on a stream, late rows within `delay` still count."""
    timed = events.withWatermark(time, delay) if events.isStreaming else events
    counted = timed.groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), *keys, "n")


def first_seen(events: DataFrame, time: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """One row for each key; on a stream, of those within `delay` of each other."""
    if events.isStreaming:
        return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def barcode_totals(pairs: DataFrame) -> DataFrame:
    """barcode, n; on a stream, for the update and complete modes."""
    return pairs.where("barcode IS NOT NULL").groupBy("barcode").agg(F.count(F.lit(1)).alias("n"))


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """What a finite stream leaves in memory after all its input."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)

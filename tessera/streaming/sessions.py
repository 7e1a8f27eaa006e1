"""Structured Streaming forms of sessionization and of re-scoring on arrival."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_sessions(events: DataFrame, time: str, gap: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """Sessions by time gaps alone; a gap of exactly the limit doesn't break, as in the batch form."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def rescore_on_arrival(frames: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Score each micro-batch of newly arrived rows and append it; a batch that runs again replaces its own folder."""

    def run(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return frames.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Incremental state: crawl records, sliding rate limits, and their streaming forms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_state(state: DataFrame, seen: DataFrame) -> DataFrame:
    """State by url after a run: seen rows replace theirs as ``active``; others stay and become ``not_seen``. Nothing is deleted."""
    kept = state.join(seen.select("url"), "url", "left_anti").withColumn("status", F.lit("not_seen"))
    return seen.withColumn("status", F.lit("active")).unionByName(kept.select(*seen.columns, "status"))


def rate_limit(events: DataFrame, limit: int, seconds: float = 60.0) -> DataFrame:
    """``event_id, user_id, allowed``: at most ``limit`` allowed events of a user in a sliding window; rejected ones do not count.

    Exact, since it folds each user's events in time order; tasks stream sorted rows and hold the ``limit`` last allowed times.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, held = None, []
        for batch in it:
            ids, users, stamps = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for u, t in zip(users, stamps, strict=True):
                if u != user:
                    user, held = u, []
                while held and t - held[0] > seconds * 1e6:
                    held.pop(0)
                out.append(len(held) < limit)
                if out[-1]:
                    held.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(users, pa.int64()), pa.array(out, pa.bool_())], names=["event_id", "user_id", "allowed"])

    rows = events.select(F.col("event_id").cast("long"), F.col("user_id").cast("long"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id").mapInArrow(run, "event_id long, user_id long, allowed boolean")


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling event-time counts by type; batch or streaming (an extension)."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def new_texts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows of a stream whose text_hash was not seen within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["text_hash"])

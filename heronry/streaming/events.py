"""Structured Streaming counterparts of the event folds.

The log is ordered by event_id; late events (at or under the high-water mark of what was folded) are refused
as in the batch log, and what a session was delivered expires by a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SALIENCE = "aggregate_id long, salience double, access_count long, last_access_at timestamp"
STATE = "salience double, access_count long, last_us long, last_id long"


def salience_stream(log: DataFrame, beta: float = 0.05) -> DataFrame:
    """Streaming log (event_id, kind, aggregate_id, ts timestamp) -> salience of each aggregate as it changes.
    Events of a batch are folded in the order of event_id; ones not above the last folded are refused."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, n, last, high = state.get if state.exists else (0.0, 0, -1, -1)
        rows = pd.concat(list(batches)).sort_values("event_id")
        for event_id, ts in zip(rows["event_id"], rows["ts"], strict=True):
            if event_id <= high:
                continue
            us = pd.Timestamp(ts).value // 1000
            age = (us - last) / 8.64e10 if n else 0.0
            s, n, last, high = max(0.0, s - beta * age + 1), n + 1, us, int(event_id)
        state.update((s, n, last, high))
        yield pd.DataFrame({"aggregate_id": [key[0]], "salience": [s], "access_count": [n], "last_access_at": [pd.Timestamp(last * 1000)]})

    accesses = log.where("kind = 'access'").select("aggregate_id", "event_id", "ts")
    return accesses.groupBy("aggregate_id").applyInPandasWithState(fold, SALIENCE, STATE, "update", GroupStateTimeout.NoTimeout)


def delivered_stream(delivered: DataFrame, ttl: str = "7 days") -> DataFrame:
    """(session_id, memory_id, created_at): the first delivery of each pair within the time to live."""
    return delivered.withWatermark("created_at", ttl).dropDuplicatesWithinWatermark(["session_id", "memory_id"])


def windowed_requests(log: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Requests by kind in windows of event time; late rows up to the watermark count."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n")).select("window.start", "window.end", "kind", "n")


def projected(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps per-aggregate counts under path/batch=<id> up to date: each micro-batch adds its own sums, written
    under its number, so that a batch that is run again replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("aggregate_id", "kind").agg(F.count("*").alias("n"), F.max("event_id").alias("high"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return log.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def projection(spark, path: str) -> DataFrame:
    """Sums of all micro-batches."""
    return spark.read.parquet(path).groupBy("aggregate_id", "kind").agg(F.sum("n").alias("n"), F.max("high").alias("high"))

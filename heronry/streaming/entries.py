"""The entry fold as a stream: what operators.events.reduced_entries gives of a whole log, kept up to date event by event.

Of an aggregate only the entry created last can still change (a revision closes it, a retract retires it), so the state
is that entry and the number of the last event: it doesn't grow with the log. Entries that expire wait in a map until a
timer of event time takes them. A stream can start from a snapshot of the fold instead of the whole log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from heronry.operators.events import reduced_entries

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times are microseconds in state, so that nothing depends on a zone.
CURRENT = "high long, memory_id long, scope_id long, valid_from long, gone_at long, supersedes long"
CHANGES = "version long, change string, memory_id long, aggregate_id long, scope_id long, status string, retention_stage string, valid_from long, valid_to long, superseded_by long, supersedes long"
NAMES = [c.split()[0] for c in CHANGES.split(", ")]
NONE = -1


class EntryFold(StatefulProcessor):
    """Changes of one aggregate's entries. Events are folded in the order of event_id; one at or under the last folded is
    refused, and says so. With `ttl` seconds an entry that nothing has closed by then expires."""

    def __init__(self, ttl: int | None = None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", CURRENT)
        self.waiting = handle.getMapState("waiting", "memory_id long", "due long")

    def _change(self, key: tuple, version: int, change: str, entry: dict, valid_to: int | None = None, superseded_by: int | None = None) -> tuple:
        gone = entry["gone_at"] != NONE
        status = "retired" if gone else "superseded" if superseded_by is not None else "active"
        ends = entry["gone_at"] if gone else valid_to
        supersedes = None if entry["supersedes"] == NONE else entry["supersedes"]
        return version, change, entry["memory_id"], key[0], entry["scope_id"], status, "tombstone" if gone else "active", entry["valid_from"], ends, superseded_by, supersedes

    def _settled(self, memory_id: int) -> None:
        if self.ttl is not None and self.waiting.containsKey((memory_id,)):
            self.waiting.removeKey((memory_id,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.current.get() if self.current.exists() else None
        entry = dict(zip([c.split()[0] for c in CURRENT.split(", ")], map(int, found), strict=True)) if found is not None else {"high": NONE, "memory_id": NONE}
        events = pd.concat(list(rows)).sort_values("event_id")
        out: list[tuple] = []
        for event_id, kind, scope_id, us in zip(events["event_id"].tolist(), events["kind"].tolist(), events["scope_id"].tolist(), events["us"].tolist(), strict=True):
            if event_id <= entry["high"]:
                out.append((event_id, "refused", NONE, key[0], scope_id, None, None, us, None, None, None))
                continue
            entry["high"] = event_id
            known = entry["memory_id"] != NONE
            if kind == "retract":
                if known:
                    entry["gone_at"] = max(entry["gone_at"], us)
                    out.append(self._change(key, event_id, "retired", entry))
                    self._settled(entry["memory_id"])
                continue
            if known and kind == "revise":
                out.append(self._change(key, event_id, "closed", entry, us, event_id))
                self._settled(entry["memory_id"])
            entry = {"high": event_id, "memory_id": event_id, "scope_id": scope_id, "valid_from": us, "gone_at": NONE, "supersedes": entry["memory_id"] if kind == "revise" else NONE}
            out.append(self._change(key, event_id, "created", entry))
            if self.ttl is not None:
                due = us // 1000 + self.ttl * 1000
                self.waiting.updateValue((event_id,), (due,))
                self.handle.registerTimer(due)
        if entry["memory_id"] != NONE:
            self.current.update(tuple(entry[c.split()[0]] for c in CURRENT.split(", ")))
        elif entry["high"] != NONE:
            self.current.update((entry["high"], NONE, NONE, NONE, NONE, NONE))
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(int(k[0]) for k, v in self.waiting.iterator() if int(v[0]) <= now)
        for memory_id in due:
            self.waiting.removeKey((memory_id,))
        yield self._frame([(memory_id, "expired", memory_id, key[0], None, None, None, None, now * 1000, None, None) for memory_id in due])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.current.update(tuple(int(row[c.split()[0]]) for c in CURRENT.split(", ")))

    def close(self) -> None:
        pass

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=NAMES)
        for c in ("valid_from", "valid_to", "superseded_by", "supersedes", "scope_id"):
            frame[c] = frame[c].astype("Int64")
        return frame


def open_entries(log: DataFrame) -> DataFrame:
    """A snapshot of the fold: (aggregate_id, CURRENT) of each aggregate, by the batch fold of a log."""
    made = log.where("kind in ('assert', 'revise', 'retract')")
    high = made.groupBy("aggregate_id").agg(F.max("event_id").alias("high"))
    newest = F.row_number().over(Window.partitionBy("aggregate_id").orderBy(F.col("memory_id").desc()))
    last = reduced_entries(log).withColumn("n", newest).where("n = 1")
    gone = F.when(F.col("status") == "retired", micros("valid_to"))
    last = last.select("aggregate_id", "memory_id", F.col("scope_id").cast("long").alias("scope_id"), micros("valid_from").alias("valid_from"), gone.alias("gone_at"), F.col("supersedes").cast("long").alias("supersedes"))
    rows = high.join(last, "aggregate_id", "left")
    return rows.select("aggregate_id", "high", *[F.coalesce(c, F.lit(NONE)).cast("long").alias(c) for c in ("memory_id", "scope_id", "valid_from", "gone_at", "supersedes")])


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def entry_changes(log: DataFrame, snapshot: DataFrame | None = None, ttl: int | None = None, late: str = "0 seconds") -> DataFrame:
    """Streaming log (event_id, kind, aggregate_id, scope_id, ts) -> CHANGES as they happen: created, closed, retired,
    expired, or a refused event. snapshot is what open_entries gives of the log so far. With ttl, time is that of events,
    and rows later than `late` are dropped as Spark does."""
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = log.where("kind in ('assert', 'revise', 'retract')").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.select("event_id", "kind", F.col("aggregate_id").cast("long").alias("aggregate_id"), F.col("scope_id").cast("long").alias("scope_id"), F.unix_micros("ts").alias("us"), "ts")
    if ttl is not None:
        rows = rows.withWatermark("ts", late)
    first = snapshot.groupBy("aggregate_id") if snapshot is not None else None
    return rows.groupBy("aggregate_id").transformWithStateInPandas(EntryFold(ttl), CHANGES, "Update", "EventTime" if ttl is not None else "None", first)


def kept(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the changes of each micro-batch under its number, so that one that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries as the changes so far leave them, in the columns of reduced_entries."""
    changes = spark.read.parquet(path).where("change in ('created', 'closed', 'retired')")
    last = changes.groupBy("memory_id").agg(F.max_by(F.struct(*[c for c in NAMES if c not in ("version", "change", "memory_id")]), "version").alias("e")).select("memory_id", "e.*")
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return last.select("memory_id", "aggregate_id", "scope_id", "status", "retention_stage", at("valid_from"), at("valid_to"), "superseded_by", "supersedes")

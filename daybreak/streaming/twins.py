"""Streaming twins of the stateful operators: a change ledger and a cooldown with keyed state that expires.

State lies in RocksDB, by key: a micro-batch reads and writes the keys it has rows or timers for, and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from daybreak.session import ship

LEDGER = "source string, identity string, fingerprint string, pos long, id string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _prepared(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class Ledger(StatefulProcessor):
    """The last fingerprint of each (source, identity); the first row of a micro-batch that differs from it goes on."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "fingerprint string", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:  # only the first row in order is held
            best = frame.loc[[frame["pos"].idxmin()]]
            first = best if first is None or best["pos"].iloc[0] < first["pos"].iloc[0] else first
        if first is None:
            return
        new, known = first["fingerprint"].iloc[0], self.last.get() if self.last.exists() else None
        self.last.update((new,))  # also renews the time it is kept
        if known is None or known[0] != new:
            yield first

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        self.last.update((initialState["fingerprint"].iloc[0],))


def ledger(stream: DataFrame, *, keep_ms: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """The rows (source, identity, fingerprint, pos, id) of a stream that change the ledger.

    keep_ms: how long a key that isn't seen any more is remembered, for ever by default. known: (source, identity, fingerprint) of
    a ledger that the stream carries on, one row a key; it is read when the stream first starts.
    """
    _prepared(stream.sparkSession)
    columns = [c.split()[0] for c in LEDGER.split(", ")]
    initial = known.groupBy("source", "identity") if known is not None else None
    return stream.select(*columns).groupBy("source", "identity").transformWithStateInPandas(Ledger(keep_ms), LEDGER, "append", "ProcessingTime" if keep_ms else "None", initialState=initial)


def run_ledger(stream: DataFrame, table_path: str, checkpoint: str, *, keep_ms: int | None = None, known: DataFrame | None = None) -> None:
    """Appends what the available rows change to the ledger at table_path; Spark's file sink counts each micro-batch once."""
    spark = stream.sparkSession
    changes = ledger(stream, keep_ms=keep_ms, known=known)
    empty = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    if keep_ms:  # else empty batches follow one another without end, as time goes on
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        _append(changes, table_path, checkpoint)
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", empty)


def _append(changes: DataFrame, table_path: str, checkpoint: str) -> None:
    changes.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Cooldown(StatefulProcessor):
    """Rows wait until the watermark has passed them and are then taken in event order, so late ones change nothing.

    The state of a key is the last second of its cooldown and the rows that wait. A timer drops it when the watermark has passed that
    second and no row waits: whatever comes then is later and is delivered without it.
    """

    def __init__(self, minutes: int, names: list[str]):
        self.minutes, self.names = minutes, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")
        self.waiting = handle.getListState("waiting", "sec long, event_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            self.waiting.appendList(list(zip(frame["sec"].tolist(), frame["event_id"].tolist())))
            earliest = min(int(frame["sec"].min()), earliest if earliest is not None else int(frame["sec"].min()))
        if earliest is not None:
            self.handle.registerTimer(1000 * earliest)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        until = self.until.get()[0] if self.until.exists() else None
        before, sent = until, []
        due = [x for x in waiting if x[0] <= passed]
        for sec, event in due:
            if until is None or sec > until:
                until = sec + 60 * self.minutes
                sent.append(event)
        later = waiting[len(due) :]
        if due:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        if later:
            self.handle.registerTimer(1000 * later[0][0])
        if until is not None and until <= passed and not later:
            self.until.clear()
        elif until is not None:
            if until != before:
                self.until.update((until,))
            self.handle.registerTimer(1000 * until)
        if sent:
            yield pd.DataFrame({**{n: [k] * len(sent) for n, k in zip(self.names, key)}, "event_id": sent})


def cooldown(stream: DataFrame, minutes: int, *, delay: str = "0 seconds", keys: tuple[str, ...] = ("event_type", "user_id")) -> DataFrame:
    """(keys, event_id) of delivered rows of a stream (keys, sec, event_id): each is its key's first after the cooldown of the one delivered before, whose last second still suppresses.

    A row is decided when the watermark, the latest second seen less `delay`, has passed it; rows that come even later are dropped.
    """
    _prepared(stream.sparkSession)
    types = dict(stream.dtypes)
    rows = stream.withColumn("at", F.timestamp_seconds("sec")).withWatermark("at", delay)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "event_id long"])
    return rows.groupBy(*keys).transformWithStateInPandas(Cooldown(minutes, list(keys)), schema, "append", "EventTime")


def late_counts(stream: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Rows per type and window under a watermark; rows later than it are dropped by the engine."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")

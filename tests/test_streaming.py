"""Streaming twins over several micro-batches give the batch operators' rows, and their state goes when it is no longer needed."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from daybreak.operators import state
from daybreak.operators.bindings import event_rows
from daybreak.plans import ledger
from daybreak.streaming import twins

FOLDER = "/root/testdata/sf0.001"


def _parts(df, path, order, n=3):
    whole = df.orderBy(order).toPandas()
    size = -(-len(whole) // n)
    for i in range(n):
        df.sparkSession.createDataFrame(whole.iloc[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)


def _files(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def _run(df, tmp_path):
    df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()


def _kept(spark, tmp_path, name):
    return spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "c"))


EVENTS = "event_type string, user_id long, sec long, event_id long"
#: A row of a key of its own, so late that the watermark passes all others.
LAST = [("end", 0, 4_000_000_000, -1)]


def test_cooldown_stream_equals_batch(spark, tmp_path):
    e = event_rows(spark, FOLDER).select("event_type", F.col("user_id").cast("long").alias("user_id"), "sec", F.col("event_id").cast("long").alias("event_id"))
    _parts(e, str(tmp_path / "in"), "sec")
    spark.createDataFrame(LAST, EVENTS).write.mode("append").parquet(str(tmp_path / "in"))
    _run(twins.cooldown(_files(spark, EVENTS, tmp_path / "in"), 360), tmp_path)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("event_id >= 0").select("event_type", "user_id", "event_id").collect())
    want = sorted(tuple(r) for r in state.greedy_cooldown(e, ["event_type", "user_id"], "sec", "event_id", 360).select("event_type", "user_id", "event_id").collect())
    assert got == want and len(set(got)) == len(got)
    assert {r.key.event_type for r in _kept(spark, tmp_path, "until").select("key").collect()} <= {"end"}


def test_rows_out_of_order_within_the_delay_are_decided_in_order(spark, tmp_path):
    batches = [[("a", 1, 1000, 1), ("a", 1, 5000, 3)], [("a", 1, 1500, 2), ("a", 1, 4599, 5), ("b", 1, 4700, 6)], [("a", 1, 9000, 7)], LAST]
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in the order of their times
    _run(twins.cooldown(_files(spark, EVENTS, tmp_path / "in"), 60, delay="2 hours"), tmp_path)
    got = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).where("event_id >= 0").collect())
    assert got == [1, 3, 6, 7]  # 2 and 5 lie within an hour of 1; 3 comes after it


def test_ledger_stream_equals_batch(spark, tmp_path):
    batch = ledger._merged(ledger._batch(spark, FOLDER))
    first = batch.where(ledger.FIRST_BATCH).drop("lang")
    batch = batch.select("source", "identity", "fingerprint", "pos", "id")
    seen = set()
    for part in (first.select(batch.columns), batch):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        twins.run_ledger(_files(spark, batch.schema, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"))
        before, seen = seen, {r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert seen - before == {r.id for r in ledger.ledger_changes(spark, FOLDER).collect()}
    assert _kept(spark, tmp_path, "last").count() == batch.select("source", "identity").distinct().count()


def test_ledger_carries_on_a_known_one_and_takes_the_first_change(spark, tmp_path):
    rows = [("s", "1", "new", 5, "b"), ("s", "1", "old", 4, "a"), ("s", "2", "x", 1, "c"), ("s", "3", "y", 9, "e"), ("s", "3", "z", 2, "d")]
    spark.createDataFrame(rows, twins.LEDGER).coalesce(1).write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("s", "1", "old"), ("s", "2", "w"), ("s", "9", "q")], "source string, identity string, fingerprint string")
    twins.run_ledger(_files(spark, twins.LEDGER, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), known=known)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["c", "d"]


@pytest.mark.parametrize(("keep_ms", "times"), [(None, 1), (1, 2)])
def test_ledger_forgets_what_is_not_seen_any_more(spark, tmp_path, keep_ms, times):
    for _ in range(2):
        spark.createDataFrame([("s", "1", "same", 1, "a")], twins.LEDGER).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        twins.run_ledger(_files(spark, twins.LEDGER, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), keep_ms=keep_ms)
        time.sleep(0.1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == times


def test_late_rows_are_counted_in_their_window(spark, tmp_path):
    e = event_rows(spark, FOLDER).select(F.timestamp_seconds("sec").alias("ts"), "event_type", "event_id")
    _parts(e, str(tmp_path / "in"), "event_id")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    twins.late_counts(stream).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("late").agg(F.sum("n")).first()[0] <= e.count()

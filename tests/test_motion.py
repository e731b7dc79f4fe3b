"""Sessions on pauses about the limit, against their SQL."""

from __future__ import annotations

import datetime

import duckdb

from daybreak.plans import motion
from tests.oracle import same


def test_sessions_break_after_an_hour(spark, tmp_path):
    start = datetime.datetime(2024, 1, 5)
    rows = [(user * 10 + k, start + datetime.timedelta(seconds=s), user, "open", 1.0, '{"k": 1}') for user, pause in ((1, 3599), (2, 3600), (3, 3601), (4, 3602)) for k, s in enumerate((0, pause, 2 * pause))]
    rows += [(50, None, 3, "open", 1.0, '{"k": 1}'), (51, None, 3, "open", 1.0, '{"k": 1}'), (52, start, None, "open", 1.0, '{"k": 1}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    same(motion.stream_sessions(spark, str(tmp_path)), con, motion.ORACLES["stream_sessions"])

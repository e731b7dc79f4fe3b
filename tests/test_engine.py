"""Runs from end to end: collection, cooldown, atomic state, rendering."""

from __future__ import annotations

import pytest

from daybreak import engine, profiles, render, store


@pytest.fixture
def items(spark):
    rows = [("doc:1", "feed", "feed_item", "New release", "b", "https://a.example/1", "primary", False, False, False, 1), ("doc:2", "feed", "document", "Later", "b", None, None, False, True, False, 2)]
    return {"feed_registry": lambda: spark.createDataFrame(rows, engine.ITEM), "unused": lambda: 1 / 0}


def test_a_delivered_item_rests_until_its_cooldown_ends(spark, items, tmp_path):
    state, sent = store.Store(spark, f"file://{tmp_path}"), []
    args = ("feed.update.default", items, state)
    assert engine.run(*args, "2026-04-20T12:00:00Z", sent.append) == "completed"
    assert [r["id"] for r in sent[0]] == ["doc:1", "doc:2"]
    engine.run(*args, "2026-04-20T13:00:00Z", sent.append)
    engine.run(*args, "2026-04-20T13:00:01Z", sent.append)
    assert [len(s) for s in sent] == [2, 0, 2]
    assert state.read("trigger_runs").where("status = 'completed'").count() == 3
    assert "[New release](https://a.example/1)" in render.digest(sent[0]) and "- None." in render.digest([])


def test_a_failed_delivery_leaves_no_suppression(spark, items, tmp_path):
    state = store.Store(spark, f"file://{tmp_path}")
    assert engine.run("feed.update.default", items, state, "2026-04-20T12:00:00Z", lambda rows: 1 / 0) == "failed"
    assert state.read("suppression_history").count() == 0 and state.read("trigger_runs").first().status == "failed"


def test_records_are_idempotent(spark, tmp_path):
    state = store.Store(spark, f"file://{tmp_path}")
    for _ in range(2):
        state.commit({"feedback_log": state.record("feedback_log", [{"category": "c", "signal": "s"}])})
    assert state.read("feedback_log").count() == 1
    new = spark.createDataFrame([("c1", None, "t2", None, "boom")], store.SCHEMAS["connector_cursors"])
    old = spark.createDataFrame([("c1", "9", "t1", "t1", None)], store.SCHEMAS["connector_cursors"])
    state.commit({"connector_cursors": old})
    assert state.upserted("connector_cursors", new).first()[:] == ("c1", "9", "t2", None, "boom")


def test_profiles_and_presets_agree():
    assert len(profiles.PROFILES) == 12 and all(p.preset in profiles.PRESETS for p in profiles.PROFILES.values())


def test_rendering():
    assert [b["kind"] for b in render.blocks("# T\n- a\n- **b**\nx [y](https://z.example)")] == ["heading", "list", "text"]
    assert render.segments("x [y](https://z.example) **b**") == [{"text": "x "}, {"link": "https://z.example", "text": "y"}, {"text": " "}, {"bold": "b"}]
    assert render.leave_now(None) is None and render.action_prep({"item": "milk"}) == "Ready to order: item milk"
    calls = iter([ValueError("x"), "done"])

    def flaky():
        value = next(calls)
        if isinstance(value, Exception):
            raise value
        return value

    out, log = render.with_retries(flaky, wait=lambda s: None)
    assert out == "done" and [a["status"] for a in log] == ["failed", "completed"]
    assert store.merged_notes("old", "e") == '{"last_error": "e", "review_note": "old"}'

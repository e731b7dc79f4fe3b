"""A run's state changes as one: killed anywhere it is all or nothing, and runs side by side lose nothing."""

from __future__ import annotations

import json

import pytest

from daybreak import engine, maintenance, store

ROWS = [("i1", "feed", "feed_item", "One", "b", "https://a.example/1", "primary", False, False, False, 1, "9", "2024-01-01T00:00:00Z")]
SCHEMA = f"{engine.ITEM}, {engine.OPTIONAL}"
NOW = "2024-01-02T12:00:00Z"


class Killed(BaseException):
    """Ends a run as the death of its process would."""


class Dying(store.Store):
    """Dies before its n-th step that others could see."""

    def __init__(self, spark, root, after):
        super().__init__(spark, root)
        self.left = after

    def _step(self):
        self.left -= 1
        if self.left < 0:
            raise Killed

    def _write(self, name, rows):
        self._step()
        folder = super()._write(name, rows)
        self._step()
        return folder

    def _point(self, number, tables):
        self._step()
        super()._point(number, tables)
        self._step()


def seen(state):
    """What the tables say about the run."""
    at = state.snapshot()
    runs = [r.status for r in state.read("trigger_runs", at).collect()]
    counts = [state.read(t, at).count() for t in ("deliveries", "suppression_history", "connector_cursors", "ledger")]
    return runs, counts, any(name.startswith("archive/") for name in at.tables)


def test_a_killed_run_leaves_all_or_nothing(spark, tmp_path):
    given = {"feed_registry": lambda: spark.createDataFrame(ROWS, SCHEMA)}
    steps, outcomes = 0, []
    while not outcomes or outcomes[-1][0] != ["completed"] or steps == 0:
        root = f"file://{tmp_path}/{steps}"
        try:
            engine.run("feed-update", given, Dying(spark, root, steps), NOW, keep_ledger=True, archive=True)
        except Killed:
            pass
        outcomes.append(seen(store.Store(spark, root)))
        if outcomes[-1][0] == ["completed"]:
            break
        # the same run again, by a process that lives
        if steps % 9 == 0:
            assert engine.run("feed-update", given, store.Store(spark, root), NOW, keep_ledger=True, archive=True) == "completed"
            assert seen(store.Store(spark, root)) == (["completed"], [1, 1, 1, 1], True)
        steps += 3  # both what is before a step and what is after it
    assert steps > 15
    for runs, counts, archived in outcomes[:-1]:
        assert (runs, counts, archived) in (([], [0, 0, 0, 0], False), (["started"], [0, 0, 0, 0], False))
    assert outcomes[-1] == (["completed"], [1, 1, 1, 1], True)


def test_a_commit_on_an_old_snapshot_is_refused_and_made_anew(spark, tmp_path):
    state = store.Store(spark, f"file://{tmp_path}")
    old = state.snapshot()
    state.commit({"feedback_log": state.record("feedback_log", [{"category": "a"}])})
    with pytest.raises(store.Conflict):
        state.commit({"feedback_log": state.record("feedback_log", [{"category": "b"}])}, old)
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("next-")] and len(list(tmp_path.glob("feedback_log-*"))) == 1
    tries = []

    def change(at):
        tries.append(at.number)
        if len(tries) == 1:  # another run is faster
            state.commit({"feedback_log": state.record("feedback_log", [{"category": "c"}])})
        return {"feedback_log": state.record("feedback_log", [{"category": "b"}], at)}

    state.transact(change)
    assert tries == [1, 2] and sorted(r.category for r in state.read("feedback_log").collect()) == ["a", "b", "c"]


def test_runs_side_by_side_write_an_item_once(spark, tmp_path):
    """A second run that planned on the same ledger and commits later."""
    state = store.Store(spark, f"file://{tmp_path}")
    given = {"feed_registry": lambda: spark.createDataFrame(ROWS, SCHEMA)}

    def meanwhile(rows):
        if state.read("ledger").count() == 0:
            assert engine.run("feed-update", given, state, "2024-01-02T12:00:01Z", keep_ledger=True) == "completed"

    assert engine.run("feed-update", given, state, NOW, meanwhile, keep_ledger=True) == "completed"
    assert engine.read_ledger(state).count() == 1 and state.read("trigger_runs").where("status = 'completed'").count() == 2


def test_items_are_collected_once_and_briefed(spark, tmp_path):
    calls, texts = spark.sparkContext.accumulator(0), []

    def supply():
        def count(batches):
            for b in batches:
                calls.add(b.num_rows)
                yield b

        return spark.createDataFrame(ROWS, SCHEMA).coalesce(1).mapInArrow(count, SCHEMA)

    state = store.Store(spark, f"file://{tmp_path}")
    more = {"keep_ledger": True, "archive": True, "errors": {"other": "boom"}}
    assert engine.run("morning-digest", {"feed_registry": supply}, state, NOW, brief=texts.append, **more) == "completed"
    assert calls.value == 1 and "[One](https://a.example/1)" in texts[0] and "- other: boom" in texts[0]
    from daybreak.render import extractive_summary

    assert engine.run("evening-digest", {"feed_registry": supply}, store.Store(spark, f"file://{tmp_path}/b"), NOW, brief=texts.append, summarizer=extractive_summary) == "completed"
    assert texts[1].startswith("## ") and "- [One](https://a.example/1)" in texts[1]


def test_maintenance(spark, tmp_path):
    state = store.Store(spark, f"file://{tmp_path}")
    notes = [("n1", "notes", "note", "Milk", "Preferred store: Shop", None, None, False, True, False, 1)]
    engine.run("shopping-replenishment", {"notes": lambda: spark.createDataFrame(notes, engine.ITEM)}, state, NOW)
    key = state.read("approval_action_log").first().action_id
    later = "2024-01-03T00:00:00Z"
    with pytest.raises(ValueError, match="does not accept error"):
        maintenance.maintain("complete-action", state, later, key="unknown", details={"error": "x"})
    with pytest.raises(ValueError, match="no such action"):
        maintenance.maintain("approve-action", state, later, key="unknown")
    with pytest.raises(ValueError, match="pending and not_executed"):
        maintenance.maintain("failed-action", state, later, key=key)
    maintenance.maintain("approve-action", state, later, key=key)
    maintenance.maintain("failed-action", state, later, key=key, details={"error": "é", "provider": "p", "store": "left out", "retryable": True})
    row = state.read("approval_action_log").first()
    assert (row.user_decision, row.execution_result) == ("approved", "failed") and json.loads(row.execution_details) == {"error": "é", "provider": "p", "retryable": True}
    assert sorted(r.signal for r in state.read("feedback_log").collect()) == ["failed", "retryable_failure"]
    text = maintenance.maintain("state-summary", state, later, output=str(tmp_path / "out" / "summary.md"))
    assert "details=error=é, provider=p, retryable=True" in text and "action_execution / shopping.replenishment / failed: 1" in text and (tmp_path / "out" / "summary.md").read_text() == text
    held = state.read("suppression_history").first().suppression_id
    maintenance.maintain("supersede-suppression", state, later, key=held)
    with pytest.raises(ValueError, match="superseded already"):
        maintenance.maintain("supersede-suppression", state, later, key=held)
    maintenance.maintain("dismiss-suppression", state, later, key=held)
    assert state.read("suppression_history").first()[-2:] == ("dismissed", True)
    with pytest.raises(ValueError, match="is dismissed"):
        maintenance.maintain("expire-suppression", state, later, key=held)
    done = []
    maintenance.maintain("refresh-chatgpt-history", state, later, refreshers={"refresh-chatgpt-history": lambda: done.append(1)})
    assert done == [1] and len(maintenance.COMMANDS) == 14
    for wrong in ("refresh-x-oauth2", "nothing"):
        with pytest.raises(ValueError):
            maintenance.maintain(wrong, state, later)

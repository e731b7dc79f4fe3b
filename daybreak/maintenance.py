"""Commands that maintain state: approvals and their execution, suppressions, summaries of the state and refreshed histories."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import functions as F

from daybreak import render
from daybreak.store import Store

# What a command needs and makes of an action (decision, result) and of a suppression.
ACTIONS = {
    "approve-action": (("pending", None), ("approved", "approved_pending_execution")),
    "reject-action": (("pending", None), ("rejected", "cancelled")),
    "complete-action": (("approved", "approved_pending_execution"), ("approved", "executed")),
    "failed-action": (("approved", "approved_pending_execution"), ("approved", "failed")),
}
DETAILS = {"approve-action": (), "reject-action": (), "complete-action": ("receipt", "provider", "store", "order_id"), "failed-action": ("error", "provider", "retryable")}
#: Details that a command leaves out though they may be given.
PASSED_OVER = {"failed-action": ("store",)}
SUPPRESSIONS = {"dismiss-suppression": "dismissed", "expire-suppression": "expired", "supersede-suppression": None}
REFRESHES = ("refresh-grok-history", "refresh-grok-history-fallback", "refresh-chatgpt-history", "prepare-chatgpt-history", "refresh-x-oauth2", "refresh-x-browser-profile")
COMMANDS = (*ACTIONS, *SUPPRESSIONS, *REFRESHES, "state-summary")


def act(store: Store, command: str, action_id: str, now: str, details: Mapping[str, object] | None = None) -> None:
    """Moves an approval on; what an execution came to is kept with it and told to the feedback log, all in one commit.

    Details that the command doesn't take are an error before anything is looked up, as are an unknown action and a state that doesn't allow the command.
    """
    given = {k: v for k, v in (details or {}).items() if v}
    if refused := given.keys() - {*DETAILS[command], *PASSED_OVER.get(command, ())}:
        raise ValueError(f"{command} does not accept {', '.join(sorted(refused))}")
    (decision, result), (new_decision, new_result) = ACTIONS[command]
    kept = {k: given[k] for k in DETAILS[command] if k in given}

    def change(at):
        row = store.read("approval_action_log", at).where(F.col("action_id") == action_id).first()
        if row is None:
            raise ValueError("no such action")
        if row.user_decision != decision or result is not None and row.execution_result != result:
            raise ValueError(f"{command} does not apply to an action that is {row.user_decision} and {row.execution_result}")
        told = {"run_id": row.run_id, "category": "action_execution", "subject": row.action_kind, "value": "1", "recorded_at": now}
        signals = [new_result, *(["retryable_failure"] if kept.get("retryable") else [])] if result else []
        text = json.dumps(kept, ensure_ascii=False) if kept else None
        tables = {"approval_action_log": store.updated("approval_action_log", action_id, at, user_decision=new_decision, execution_result=new_result, execution_details=text, recorded_at=now)}
        return tables | ({"feedback_log": store.record("feedback_log", [told | {"signal": s} for s in signals], at)} if signals else {})

    store.transact(change)


def suppress(store: Store, command: str, suppression_id: str) -> None:
    """Dismisses or expires an active suppression, or marks it as superseded, which leaves it active."""

    def change(at):
        row = store.read("suppression_history", at).where(F.col("suppression_id") == suppression_id).first()
        if row is None:
            raise ValueError("no such suppression")
        status = SUPPRESSIONS[command]
        if row.dismissal_status != "active":
            raise ValueError(f"the suppression is {row.dismissal_status}")
        if status is None and row.superseded_by_higher_authority:
            raise ValueError("the suppression is superseded already")
        changed = {"superseded_by_higher_authority": True} if status is None else {"dismissal_status": status}
        return {"suppression_history": store.updated("suppression_history", suppression_id, at, **changed)}

    store.transact(change)


def state_summary(store: Store, recent: int = 20) -> str:
    """Cursors by connector, the latest actions and the feedback's totals."""
    at = store.snapshot()
    cursors = store.read("connector_cursors", at).orderBy("connector_id").collect()  # one row a connector
    actions = store.read("approval_action_log", at).orderBy(F.desc("recorded_at"), F.desc("action_id")).limit(recent).collect()
    feedback = store.read("feedback_log", at).groupBy("category", "subject", "signal").agg(F.count("*").alias("n")).orderBy("category", "subject", "signal").collect()
    return render.state_summary([r.asDict() for r in cursors], [r.asDict() for r in actions], [r.asDict() for r in feedback])


def maintain(command: str, store: Store, now: str, *, key: str | None = None, refreshers: dict[str, Callable[[], object]] | None = None, output: str | None = None, details: Mapping[str, object] | None = None) -> str | None:
    """Runs a maintenance command; a summary goes to `output` or is returned. A history is refreshed by the caller's function for it."""
    if command in ACTIONS or command in SUPPRESSIONS:
        if not key:
            raise ValueError(f"{command} needs the key of what it changes")
        act(store, command, key, now, details) if command in ACTIONS else suppress(store, command, key)
        return None
    if command in REFRESHES:
        if command not in (refreshers or {}):
            raise ValueError(f"{command} needs a function that does it")
        refreshers[command]()
        return None
    if command != "state-summary":
        raise ValueError(f"unknown command: {command}")
    text = state_summary(store)
    if output is not None:
        render.deliver(text, output)
    return text

"""Runs: collect, drop what was seen or is suppressed, diff against the ledger, score, rank, brief; state, ledger and archive are committed as one after the output."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from functools import reduce
from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybreak.functions.text import fingerprint, identity, key_values, subject_key
from daybreak.functions.times import archive_label, default_occurrence, natural_key, sort_seconds
from daybreak.operators.dedupe import ledger_diff, ledger_state
from daybreak.operators.score import scored, top_per_section
from daybreak.operators.state import after_cursor, health
from daybreak.profiles import PRESETS, profile
from daybreak.sources.exports import jsonl
from daybreak.render import briefing
from daybreak.store import ARCHIVE, Appended, Snapshot, Store
from daybreak.store import LEDGER as LEDGER_TABLE
from daybreak.summary import summarise, with_notice
from daybreak.tables import remove, stored

ITEM = "id string, source string, kind string, title string, body string, url string, tier string, saved boolean, unresolved boolean, future boolean, pos long"
#: Columns that a connector may give besides: the record's id at its provider and when it changed.
OPTIONAL = "raw_id string, changed_at string"
LEDGER = f"{ITEM}, {OPTIONAL}, identity string, fingerprint string, retrieved_at string"
Supplier = Callable[[], DataFrame]


class Connector(Protocol):
    """A source: what `collect` in it returns has the columns of ITEM, and may have those of OPTIONAL."""

    def __call__(self) -> DataFrame: ...


class Delivery(Protocol):
    """Takes the rows of a run; an error means that nothing was delivered."""

    def __call__(self, rows: list[dict]) -> None: ...


def collect(preset: str, suppliers: dict[str, Supplier], spark: SparkSession) -> DataFrame:
    """The preset's connectors in its order; connectors without a supplier are left out, an unknown preset is empty."""
    frames = [suppliers[name]().withColumn("preset_pos", F.lit(k)) for k, name in enumerate(PRESETS.get(preset, ())) if name in suppliers]
    empty = spark.createDataFrame([], f"{ITEM}, {OPTIONAL}, preset_pos int")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames, empty)


def unseen(items: DataFrame, store: Store, event: str, now: str, at: Snapshot | None = None) -> DataFrame:
    """Items beyond their source's cursor whose (source, id) isn't suppressed for the event type."""
    cursors = store.read("connector_cursors", at).select(F.col("connector_id").alias("source"), "cursor", sort_seconds(F.col("last_success_at")).alias("last_success"))
    newer = after_cursor(items.withColumn("changed", F.col("changed_at")).withColumn("changed_at", sort_seconds(F.col("changed_at"))), cursors)
    newer = newer.withColumn("changed_at", F.col("changed")).drop("changed", "cursor", "last_success")
    live = (F.col("trigger_family") == event) & (F.col("dismissal_status") == "active") & ~F.coalesce("superseded_by_higher_authority", F.lit(False))
    history = store.read("suppression_history", at).where(live & (F.col("cooldown_expires_at").isNull() | (F.try_to_timestamp("cooldown_expires_at") >= F.try_to_timestamp(F.lit(now)))))
    return newer.withColumn("subject", subject_key(F.col("source"), F.col("id"))).join(history.select("subject").distinct(), "subject", "left_anti").drop("subject")


def named(items: DataFrame) -> DataFrame:
    return items.withColumns({"identity": identity(F.col("url"), F.lit(None).cast("string"), F.col("id")), "fingerprint": fingerprint(F.col("id"), F.col("title"), F.col("body"), F.col("url"), F.col("changed_at"))})


def read_ledger(store: Store, at: Snapshot | None = None) -> DataFrame:
    """The ledger's lines of all earlier runs; what can't be parsed is skipped."""
    return store.read(LEDGER_TABLE, at).select(F.from_json("value", LEDGER).alias("v")).select("v.*").where("id is not null and fingerprint is not null")


def changes(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """The first of each (source, identity) that differs from the ledger's last line of it."""
    state = ledger_state(ledger.withColumn("seq", F.struct("retrieved_at", "id")))
    return ledger_diff(items.withColumn("order", F.struct("preset_pos", "pos")).drop("pos").withColumnRenamed("order", "pos"), state).withColumn("pos", F.col("pos.pos"))


def fresh_items(name: str, suppliers: dict[str, Supplier], store: Store, now: str, keep_ledger: bool = False, at: Snapshot | None = None) -> DataFrame:
    """The items that a run of a profile or command may deliver."""
    chosen = profile(name)
    found = named(unseen(collect(chosen.preset, suppliers, store.spark), store, chosen.event, now, at))
    return changes(found, read_ledger(store, at)) if keep_ledger else found


def ranked(items: DataFrame) -> DataFrame:
    """(section, place, id, source, score, title, url, reasons) of what is delivered of them."""
    return top_per_section(scored(items)).select("section", "place", "id", "source", "score", "title", "url", F.array_join("reasons", ", ").alias("reasons"))


def plan(profile_id: str, suppliers: dict[str, Supplier], store: Store, now: str, keep_ledger: bool = False) -> DataFrame:
    """The rows of a run."""
    return ranked(fresh_items(profile_id, suppliers, store, now, keep_ledger))


def cursors_after(items: DataFrame, store: Store, now: str, errors: dict[str, str] | None = None, at: Snapshot | None = None) -> DataFrame:
    """Cursor rows after a run: each source's largest raw id in natural order; a source with an error keeps what it had."""
    best = items.where("raw_id is not null").groupBy(F.col("source").alias("connector_id")).agg(F.max_by("raw_id", natural_key(F.col("raw_id"))).alias("cursor"))
    seen = best.select("connector_id", "cursor", F.lit(True).alias("succeeded"), F.lit(None).cast("string").alias("error"))
    failed = store.spark.createDataFrame([(k, None, False, v) for k, v in (errors or {}).items()], "connector_id string, cursor string, succeeded boolean, error string")
    old = store.read("connector_cursors", at)
    larger = seen.join(old.select("connector_id", F.col("cursor").alias("before")), "connector_id", "left")
    kept = F.when(F.col("before").isNotNull() & (natural_key(F.col("before")) > natural_key(F.col("cursor"))), F.col("before")).otherwise(F.col("cursor"))
    return health(old, larger.withColumn("cursor", kept).drop("before").unionByName(failed), now)


def approvals(items: DataFrame, kind: str = "shopping.replenishment") -> DataFrame:
    """(action_kind, subject) of the first note: what to buy, where, and its link, as JSON."""
    values = key_values(F.coalesce("body", F.lit("")))
    field = lambda key: F.try_element_at(values, F.lit(key))
    subject = F.struct(F.coalesce(field("buy"), F.col("title"), F.col("id")).alias("buy"), field("preferred store").alias("preferred_store"), field("link").alias("link"))
    return items.orderBy("preset_pos", "pos").limit(1).select(F.lit(kind).alias("action_kind"), F.to_json(subject, {"ignoreNullFields": "false"}).alias("subject"))


def run(
    name: str,
    suppliers: dict[str, Supplier],
    store: Store,
    now: str | None = None,
    deliver: Delivery = lambda rows: None,
    cooldown_minutes: int | None = None,
    *,
    brief: Callable[[str], None] | None = None,
    summarizer: Callable[[str], str] | None = None,
    keep_ledger: bool = False,
    archive: bool = False,
    label: str | None = None,
    errors: dict[str, str] | None = None,
    told: Callable[[str], None] = lambda reason: None,
) -> str:
    """Delivers the run of a profile or command and then commits all its state as one; returns the run's status.

    The run is recorded as started first, so one that dies leaves a trace, and then becomes completed, failed (nothing was delivered) or
    delivery_state_error (delivered, but the state wasn't written); `told` gets the reason of a failure. Items are
    collected once, into the shared folder; what is delivered, archived, put into the ledger and used for cursors is the same. `deliver` gets
    the rows, `brief` the text of the briefing with the notices of failed sources; with a summarizer the text has a summary of each category instead of
    the profile's own form. Delivered rows rest for the cooldown under their event type.
    """
    chosen, now = profile(name), default_occurrence(now)
    base = {"event_type": chosen.event, "profile_id": chosen.id, "occurred_at": now, "output_mode": chosen.mode, "created_at": now}
    base["run_id"] = hashlib.sha256("\x1f".join(base.values()).encode()).hexdigest()

    def ended(status: str, reason: Exception | None = None) -> str:
        if reason is not None:
            told(f"{type(reason).__name__}: {reason}")
        store.transact(lambda at: {"trigger_runs": _with_status(store, at, base, status)})
        return status

    ended("started")
    items = None
    try:
        items = stored(fresh_items(name, suppliers, store, now, keep_ledger), "items")
        rows = [r.asDict() for r in ranked(items).orderBy("section", "place").collect()]  # three rows a section
        deliver(rows)
        if brief is not None:
            brief(_text(chosen.mode, items, rows, summarizer, errors or {}))
    except Exception as failure:
        return ended("failed", failure)
    try:
        snapshot = f"{ARCHIVE}{archive_label(label, now)}" if archive else None
        store.transact(lambda at: _outcome(chosen, items, rows, base, store, at, now, cooldown_minutes, keep_ledger, snapshot, errors))
    except Exception as failure:
        return ended("delivery_state_error", failure)
    finally:
        remove(items)
    return "completed"


def _text(mode: str, items: DataFrame, rows: list[Mapping], summarizer: Callable[[str], str] | None, errors: Mapping[str, str]) -> str:
    if summarizer is not None:
        parts = summarise(items, summarizer)
        text = "\n\n".join(f"## {category}\n{made}" for category, made in parts.items())
    else:
        asked = approvals(items).first() if mode == "action_prep" else None
        text = briefing(mode, rows, asked.subject if asked else None)
    return with_notice(text, errors)


def _with_status(store: Store, at: Snapshot, base: dict, status: str) -> DataFrame:
    """The runs with this one's row at a status."""
    others = store.read("trigger_runs", at).where(F.col("run_id") != base["run_id"])
    fields = others.columns
    return others.unionByName(store.spark.createDataFrame([tuple((base | {"status": status})[f] for f in fields)], others.schema))


def _outcome(chosen, items: DataFrame, rows: list[dict], base: dict, store: Store, at: Snapshot, now: str, cooldown_minutes: int | None, keep_ledger: bool, archive: str | None, errors: dict[str, str] | None) -> dict[str, DataFrame | Appended]:
    """Every table that a delivered run changes, built on a snapshot."""
    minutes, run_id = chosen.cooldown_minutes if cooldown_minutes is None else cooldown_minutes, base["run_id"]
    keys = F.struct(F.date_format(F.try_to_timestamp(F.lit(now)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("expiry"))
    expiry = store.spark.range(1).select(keys.alias("k")).first().k.expiry
    tables: dict[str, DataFrame | Appended] = {"trigger_runs": _with_status(store, at, base, "completed")}
    tables["deliveries"] = store.record("deliveries", [{"run_id": run_id, "destination": chosen.mode, "delivered_at": now, "status": "delivered"}], at)
    if rows:
        frame = store.spark.createDataFrame([(r["source"], r["id"]) for r in rows], "source string, id string")
        subjects = [r.subject for r in frame.select(subject_key(F.col("source"), F.col("id")).alias("subject")).distinct().collect()]  # of delivered rows
        rest = {"run_id": run_id, "trigger_family": chosen.event, "reason": "already_delivered_in_same_trigger_family", "cooldown_expires_at": expiry, "dismissal_status": "active", "superseded_by_higher_authority": False}
        tables["suppression_history"] = store.record("suppression_history", [rest | {"subject": s} for s in subjects], at)
    if chosen.mode == "action_prep":
        asked = [r.asDict() for r in approvals(items).collect()]  # one row
        log = {"run_id": run_id, "approval_boundary_reached": True, "user_decision": "pending", "execution_result": "not_executed", "recorded_at": now}
        tables["approval_action_log"] = store.record("approval_action_log", [r | log for r in asked], at)
    tables["connector_cursors"] = cursors_after(items, store, now, errors, at)
    if archive is not None:
        tables[archive] = items
    if keep_ledger:
        new = changes(items, read_ledger(store, at)).withColumn("retrieved_at", F.lit(now))  # another run may have brought some meanwhile
        line = jsonl(F.struct(*(f.split()[0] for f in LEDGER.split(", "))))
        tables[LEDGER_TABLE] = Appended(new.select(line.alias("value"), F.coalesce("source", F.lit("none")).alias("of")))
    return tables

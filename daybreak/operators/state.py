"""Cursors, cooldowns, upserts and state machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybreak.functions.times import natural_key
from daybreak.operators.ordered import chains, laid_out, next_value, running, split_by_size
from daybreak.tables import stored


def after_cursor(items: DataFrame, cursors: DataFrame) -> DataFrame:
    """Items newer than their source's cursor: no id, no cursor, changed since the last success, or a larger id in natural order."""
    raw, cursor = F.col("raw_id").cast("string"), F.col("cursor").cast("string")
    keep = raw.isNull() | cursor.isNull() | (F.col("changed_at") > F.col("last_success")) | (natural_key(raw) > natural_key(cursor))
    return items.join(cursors, "source", "left").where(F.coalesce(keep, F.lit(False)))


def active_suppressions(history: DataFrame, family: str, at: Column) -> DataFrame:
    """Subjects that are suppressed for a family, which is the event type; the second of expiry still counts. A subject is the key of a source and an id."""
    live = (F.col("family") == family) & (F.col("status") == "active") & ~F.col("superseded") & (F.col("expires_at").isNull() | (F.col("expires_at") >= at))
    return history.where(live).select("subject").distinct()


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old_where_null: tuple[str, ...] = ()) -> DataFrame:
    """New rows over old ones; the named columns keep their old value where the new one is null."""
    columns = [c for c in old.columns if c != key]
    o, n = old.alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    joined = o.join(n, key, "full")
    pick = lambda c: F.when(F.col("__new"), F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep_old_where_null else F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(key, *(pick(c).alias(c) for c in columns))


#: Rows of a key that are folded over in one row of a task.
FOLDED = 4096


def greedy_cooldown(rows: DataFrame, keys: list[str], at: str, event_id: str, minutes: int) -> DataFrame:
    """Delivered rows: each is the first of its key after the cooldown of the one delivered before, whose last second still suppresses.

    Keys of up to FOLDED rows are folded over in place, those of more go by jumps, which take as many tasks as they need.
    """
    given = rows.select(*keys, at, event_id)
    small, large = split_by_size(given, keys, FOLDED)
    seen = F.array_sort(F.collect_list(F.struct(F.col(at).cast("long").alias("at"), F.col(event_id).alias("id"))))
    kind = given.schema[event_id].dataType.simpleString()
    start = F.struct(F.lit(None).cast("long").alias("until"), F.array().cast(f"array<{kind}>").alias("sent"))

    def step(held: Column, row: Column) -> Column:
        sent = held.until.isNull() | (row.at > held.until)
        after = F.struct((row.at + 60 * minutes).alias("until"), F.concat(held.sent, F.array(row.id)).alias("sent"))
        return F.when(sent, after).otherwise(held)

    out = small.groupBy(*keys).agg(seen.alias("seen")).select(*keys, F.explode(F.aggregate("seen", start, step, lambda held: held.sent)).alias(event_id))
    return out if large is None else out.unionByName(_cooldown_by_jumps(large, keys, at, event_id, minutes))


def _cooldown_by_jumps(rows: DataFrame, keys: list[str], at: str, event_id: str, minutes: int) -> DataFrame:
    """A row that no earlier one's cooldown reaches is delivered whatever came before; in one order of rows and ends of
    cooldowns it is one at which all cooldowns begun have ended. From those rows jumps lead on, each to the
    row that would follow a delivery, until it is such a row again.
    """
    place = F.struct(F.col(at).alias("at"), F.col(event_id).alias("id"))
    given = rows.select(*keys, F.col(at).alias("v"), place.alias("row"))
    none = F.lit(None).cast(given.schema["row"].dataType)
    begins = given.select(*keys, "v", F.lit(1).cast("long").alias("step"), none.alias("b"), "row")
    ends = given.select(*keys, (F.col("v") + 60 * minutes).alias("v"), F.lit(-1).cast("long").alias("step"), F.col("row").alias("b"), none.alias("row"))
    laid = laid_out(begins.unionByName(ends).withColumn("last", F.col("step") < 0), keys, ["v", "last", "row", "b"])
    opened = stored(running(laid, keys, {"open": F.col("step")}).withColumn("begin", F.when(F.col("row").isNotNull(), F.struct("row", (F.col("open") == 1).alias("free")))), "cooldowns")
    jumps = next_value(opened, keys, "begin", "to").where("b is not null and not to.free").select(*keys, "b", F.col("to.row").alias("next"))
    starts = opened.where("begin.free").select(*keys, F.col("row").alias("b"))
    return chains(starts, stored(jumps, "jumps"), keys).select(*keys, "b").distinct().select(*keys, F.col("b.id").alias(event_id))


APPROVAL = {("pending", "approve"): "approved", ("pending", "reject"): "rejected", ("approved", "complete"): "executed", ("approved", "fail"): "failed"}
SUPPRESSION = {("active", "dismiss"): "dismissed", ("active", "expire"): "expired"}


def transition(state: Column, command: Column, machine: dict[tuple[str, str], str]) -> Column:
    """The next state, or null for a command that the state doesn't allow."""
    out = None
    for (source, verb), target in machine.items():
        case = (state == source) & (command == verb)
        out = F.when(case, target) if out is None else out.when(case, target)
    return out.otherwise(None)


def health(old: DataFrame, outcomes: DataFrame, at: str) -> DataFrame:
    """Cursor rows after a poll of (connector_id, cursor, succeeded, error) outcomes: a success sets cursor and time and clears the error,
    a failure keeps both and sets it; of several outcomes of a connector a success wins."""
    best = outcomes.groupBy("connector_id").agg(F.max(F.struct(F.col("succeeded").cast("int").alias("ok"), F.col("cursor").alias("new_cursor"), F.col("error").alias("told"))).alias("o")).select("connector_id", "o.*")
    joined = old.join(best, "connector_id", "full")
    ok, polled = F.coalesce(F.col("ok") == 1, F.lit(False)), F.col("ok").isNotNull()
    return joined.select(
        "connector_id",
        F.when(ok, F.coalesce("new_cursor", "cursor")).otherwise(F.col("cursor")).alias("cursor"),
        F.when(polled, F.lit(at)).otherwise(F.col("last_poll_at")).alias("last_poll_at"),
        F.when(ok, F.lit(at)).otherwise(F.col("last_success_at")).alias("last_success_at"),
        F.when(ok, None).when(polled, F.col("told")).otherwise(F.col("last_error")).alias("last_error"),
    )

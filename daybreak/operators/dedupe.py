"""First-wins, last-wins and heaviest-wins dedupe, and the change ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key; WindowGroupLimit prunes the others before the shuffle."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def heaviest_wins(rows: DataFrame, key: str, weight: Column, pos: str) -> DataFrame:
    """Rows without a key first, then the heaviest row of each key in the order of the keys' first places; ties keep the first."""
    keyed = rows.where(F.col(key).isNotNull() & (F.col(key) != ""))
    best = keyed.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(weight, -F.col(pos))).alias("r"), F.min(pos).alias("first_pos"))
    free = rows.where(F.col(key).isNull() | (F.col(key) == "")).withColumns({"keyed": F.lit(0), "first_pos": F.col(pos)})
    return best.select("r.*", F.lit(1).alias("keyed"), "first_pos").unionByName(free)


def ledger_state(ledger: DataFrame) -> DataFrame:
    """The last fingerprint of each (source, identity); a missing one is empty."""
    return ledger.groupBy("source", "identity").agg(F.max_by(F.coalesce("fingerprint", F.lit("")), "seq").alias("fingerprint"))


def ledger_diff(batch: DataFrame, state: DataFrame) -> DataFrame:
    """The batch's first row of each (source, identity) whose fingerprint isn't the ledger's last one."""
    return first_wins(batch, ["source", "identity"], "pos").join(state, ["source", "identity", "fingerprint"], "left_anti")


def last_value_first_place(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Registry rule: each key at its first place with its last value."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (key, pos))), pos).alias("r"), F.min(pos).alias(pos)).select(key, "r.*", pos)

"""Time kernels; zoneless times are UTC."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(name: str) -> Column:
    """Whole seconds since 1970 of a time column, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({name} as timestamp_ntz))")


def iso(epoch: Column) -> Column:
    """yyyy-mm-ddThh:mm:ssZ of whole seconds since 1970."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / 86400).cast("int"))
    part = lambda n, m: F.lpad((F.floor(F.pmod(epoch, F.lit(86400)) / n) % m).cast("string"), 2, "0")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), part(3600, 24), F.lit(":"), part(60, 60), F.lit(":"), part(1, 60), F.lit("Z"))


def browser_seconds(micros: Column) -> Column:
    """Seconds since 1970 of microseconds since 1601."""
    return F.floor((micros - F.lit(11644473600000000)) / 1000000).cast("long")


def sort_seconds(text: Column) -> Column:
    """A sort key of a number of seconds or an ISO time, as text."""
    return F.coalesce(text.try_cast("double"), F.unix_micros(F.try_to_timestamp(text)) / 1e6)


def cooldown_expiry(epoch: Column, minutes: Column) -> Column:
    """The last second of a cooldown; null minutes mean a day, zero means none."""
    return epoch + 60 * F.coalesce(minutes, F.lit(1440))


def natural_key(raw: Column) -> Column:
    """Orders ids: other text, then prefix-and-number by number, then plain numbers."""
    number = F.regexp_extract(raw, r"([0-9]+)$", 1)
    prefix = F.regexp_extract(raw, r"^(.*?)[0-9]+$", 1)
    value = F.when(number == "", None).otherwise(number).cast("decimal(38,0)")
    return F.struct(
        F.when(raw.rlike(r"^[0-9]+$"), 2).when(raw.rlike(r"[0-9]$"), 1).otherwise(0).alias("rank"),
        F.when(raw.rlike(r"[0-9]$"), prefix).otherwise(raw).alias("prefix"),
        value.alias("number"),
        raw.alias("raw"),
    )


def boundary_seconds(value: str) -> Column:
    """Seconds since 1970 of a window's end: a date is its midnight in UTC, anything else an ISO time."""
    return sort_seconds(F.lit(f"{value}T00:00:00Z" if len(value) == 10 else value))


def default_occurrence(now: str | None = None) -> str:
    """The time of a run: the given one, or this second in UTC."""
    return now or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def archive_label(label: str | None, now: str) -> str:
    """The name of a run's archive: the given one, or its day."""
    return label or now[:10]

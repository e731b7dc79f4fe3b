"""Distances and dwell thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def dwell_threshold(radius: Column, newest: Column, point: Column) -> Column:
    """Metres within which a point still belongs to the newest one; wider where both accuracies are coarse."""
    coarse = newest.isNotNull() & point.isNotNull() & (F.greatest(newest, point) >= 250)
    return F.when(coarse, F.greatest(radius, 1.5 * (newest + point + 80))).otherwise(radius)


def reason_for_hour(hour: Column, default: str) -> Column:
    return F.when(hour.between(11, 13) | hour.between(17, 19), "meal_window").when(hour.between(14, 16), "snack_window").otherwise(default)


def shown_reason(reason: Column, walking: Column) -> Column:
    """What is displayed: meal, snack and transient reasons as they are, else by the way of moving."""
    return F.when(reason.isin("meal_window", "snack_window", "transient_stop"), reason).otherwise(F.when(walking, "walking_nearby").otherwise("stopped_moving"))

"""Walking segments and stationary clusters from the newest point back, as windows instead of loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybreak.functions.geo import dwell_threshold, haversine


def steps(points: DataFrame) -> DataFrame:
    """Each point with the next older one: gap in seconds, distance and speed."""
    w = Window.partitionBy("user_id").orderBy(F.desc("sec"), F.desc("event_id"))
    older = lambda c: F.lead(c).over(w)
    out = points.withColumns({"older_sec": older("sec"), "older_lat": older("lat"), "older_lon": older("lon"), "older_velocity": older("velocity")})
    out = out.withColumns({"gap": F.col("sec") - F.col("older_sec"), "metres": haversine(F.col("lat"), F.col("lon"), F.col("older_lat"), F.col("older_lon"))})
    return out.withColumn("speed", F.coalesce("velocity", "older_velocity", F.when(F.col("gap") > 0, F.col("metres") / F.col("gap"))))


def walking_segments(points: DataFrame, most_gap: int = 300, slow: float = 0.6, fast: float = 2.2, least_minutes: int = 5, least_metres: float = 120) -> DataFrame:
    """Per user the newest run of points with gaps of at most most_gap, where it looks like a walk."""
    w = Window.partitionBy("user_id").orderBy(F.desc("sec"), F.desc("event_id"))
    newer_gap = F.lag("sec").over(w) - F.col("sec")
    broken = F.when(newer_gap.isNull() | ((newer_gap > 0) & (newer_gap <= most_gap)), 0).otherwise(1)
    taken = steps(points).withColumn("broken", broken).withColumn("after", F.max("broken").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("after = 0")
    last = F.lead("sec").over(w)
    taken = taken.withColumn("own_speed", F.when(last.isNotNull(), F.col("speed")))
    newest, oldest = F.struct("sec", "event_id"), F.struct("sec", "event_id")
    seg = taken.groupBy("user_id").agg(F.count("*").alias("n"), F.max("sec").alias("newest"), F.min("sec").alias("oldest"), F.avg("own_speed").alias("speed"), F.max_by("lat", newest).alias("lat1"), F.max_by("lon", newest).alias("lon1"), F.min_by("lat", oldest).alias("lat2"), F.min_by("lon", oldest).alias("lon2"))
    minutes = F.greatest(F.lit(1), F.floor((F.col("newest") - F.col("oldest")) / 60))
    net = haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    out = seg.withColumns({"minutes": minutes.cast("long"), "net": net})
    return out.where((F.col("n") >= 2) & F.col("speed").between(slow, fast) & (F.col("minutes") >= least_minutes) & (F.col("net") >= least_metres))


def stationary_clusters(points: DataFrame, radius: float = 80, least_minutes: int = 15) -> DataFrame:
    """Per user the newest points within the threshold of the newest one, where they last long enough."""
    w = Window.partitionBy("user_id").orderBy(F.desc("sec"), F.desc("event_id"))
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    newest = lambda c: F.first(c).over(whole)
    out = points.withColumns({"lat0": newest("lat"), "lon0": newest("lon"), "acc0": newest("accuracy")})
    far = haversine(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")) > dwell_threshold(F.lit(radius), F.col("acc0"), F.col("accuracy"))
    taken = out.withColumn("after", F.max(far.cast("int")).over(whole)).where("after = 0")
    seg = taken.groupBy("user_id").agg(F.count("*").alias("n"), F.max("sec").alias("newest"), F.min("sec").alias("oldest"), F.max("acc0").alias("acc0"))
    minutes = F.floor((F.col("newest") - F.col("oldest")) / 60).cast("long")
    least = F.when((F.col("acc0") >= 250) & (F.col("n") >= 3), F.least(F.lit(10), F.lit(least_minutes))).otherwise(least_minutes)
    return seg.withColumn("minutes", minutes).where(F.col("minutes") >= least)

"""Points, dwell, calendar and audit queries, and the streaming twins run as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybreak.functions import geo, times
from daybreak.operators import dwell
from daybreak.operators.bindings import EVENTS_SQL, POINTS_SQL, event_rows, points
from daybreak.operators.dedupe import first_wins
from daybreak.plans.ledger import ISO_SQL
from daybreak.session import table

GAP, RADIUS = 43200, 8000.0


def haversine_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dwell.steps(points(spark, sf_dir)).where("gap is not null")
    return s.select("user_id", "event_id", "gap", F.round("metres", 2).alias("metres"))


def avg_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dwell.steps(points(spark, sf_dir)).groupBy("user_id").agg(F.round(F.avg("speed"), 6).alias("speed"), F.count("*").alias("n"))


def walking_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dwell.walking_segments(points(spark, sf_dir), most_gap=GAP, least_metres=1000)
    return out.select("user_id", "n", "minutes", F.round("speed", 6).alias("speed"), F.round("net", 2).alias("net"))


def stationary_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dwell.stationary_clusters(points(spark, sf_dir), RADIUS).select("user_id", "n", "minutes", "newest", "oldest")


def location_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose newest point is at most 90 minutes old at the end of January 2024."""
    newest = points(spark, sf_dir).groupBy("user_id").agg(F.max("sec").alias("newest"))
    return newest.where(1706659200 - F.col("newest") <= 90 * 60)


def recent_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 240 newest points; a velocity of -1 is none."""
    p = points(spark, sf_dir).withColumn("velocity", F.when(F.col("event_id") % 4 == 0, -1.0).otherwise(F.col("velocity")))
    return p.orderBy(F.desc("sec"), F.desc("event_id")).limit(240).select("event_id", "sec", F.round(F.nullif("velocity", F.lit(-1.0)), 6).alias("velocity"))


def local_hour_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons by the hour at UTC+9."""
    hour = F.floor(F.pmod(F.col("sec") + 9 * 3600, F.lit(86400)) / 3600).cast("int")
    return event_rows(spark, sf_dir).select("event_id", hour.alias("hour"), geo.reason_for_hour(hour, "walking_nearby").alias("reason"))


def reason_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("meal_window", "snack_window", "transient_stop", "walking_nearby", "stopped_moving", "other")))
    e = event_rows(spark, sf_dir).select("event_id", F.element_at(names, (F.col("k") % 6 + 1).cast("int")).alias("reason"), (F.col("user_id") % 2 == 0).alias("walking"))
    return e.groupBy("reason", "walking", geo.shown_reason(F.col("reason"), F.col("walking")).alias("shown")).agg(F.count("*").alias("n"))


def leave_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the event with the earliest departure among those that are due and not over."""
    o = table(spark, sf_dir, "orders").withColumn("sec", times.seconds("o_orderdate"))
    day = F.col("sec") - F.pmod(F.col("sec"), F.lit(86400))
    due = o.withColumns({"departure": F.col("sec") - 600 * F.substring("o_orderpriority", 1, 1).cast("int"), "now": day}).where((F.col("now") >= F.col("departure")) & (F.col("now") < F.col("sec") + 3600))
    return first_wins(due, ["o_custkey"], "departure", "o_orderkey").select("o_custkey", "o_orderkey", times.iso(F.col("departure")).alias("departure"))


def gap_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the gap around 1998-01-01 between the last ended event and the first later one, of 30 minutes or more."""
    now = 883612800
    o = table(spark, sf_dir, "orders").select("o_custkey", times.seconds("o_orderdate").alias("sec"))
    g = o.groupBy("o_custkey").agg(F.max(F.when(F.col("sec") + 3600 <= now, F.col("sec") + 3600)).alias("ended"), F.min(F.when(F.col("sec") > now, F.col("sec"))).alias("starts"))
    minutes = F.floor((F.col("starts") - now) / 60)
    return g.where(F.col("ended").isNotNull() & (minutes >= 30)).select("o_custkey", "ended", "starts", minutes.cast("long").alias("minutes"))


def gap_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gap between a customer's events, from the latest end so far to the next start."""
    w = Window.partitionBy("o_custkey").orderBy("sec", "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", times.seconds("o_orderdate").alias("sec"))
    g = o.withColumns({"ended": F.max(F.col("sec") + 3600).over(w.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("sec").over(w)})
    return g.where(F.col("next") - F.col("ended") >= 1800).select("o_custkey", "o_orderkey", F.floor((F.col("next") - F.col("ended")) / 60).cast("long").alias("minutes"))


def audit_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit figures as one item a user, its lines `key: value`."""
    e = event_rows(spark, sf_dir)
    a = e.groupBy("user_id").agg(F.count("*").alias("notification_rate"), F.count_if(F.col("event_type") == "error").alias("delivery_failures"))
    pairs = F.create_map(F.lit("notification_rate"), F.col("notification_rate"), F.lit("delivery_failures"), F.col("delivery_failures"))
    body = F.array_join(F.transform(F.map_entries(pairs), lambda p: F.concat(p.key, F.lit(": "), p.value.cast("string"))), "\n")
    return a.select(F.concat(F.lit("audit:"), "user_id").alias("id"), body.alias("body"))


def location_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest point of each user as a place item with its citation."""
    p = first_wins(points(spark, sf_dir), ["user_id"], F.desc("sec"), F.desc("event_id"))
    place = F.format_string("%.5f, %.5f", "lat", "lon")
    cite = F.array(F.struct(F.lit("primary").alias("relation"), place.alias("label"), F.concat(F.lit("https://maps.example.com/?q="), "event_id").alias("url")))
    text = F.array_join(F.transform(cite, lambda c: F.concat(c.relation, F.lit(": ["), c.label, F.lit("]("), c.url, F.lit(")"))), ", ")
    return p.select(F.concat(F.lit("location:"), "user_id").alias("id"), text.alias("citation"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user's events with pauses of at most an hour, as session windows; an event without a time is a session of its own.

    Seconds are whole. A window that begins where another ends joins it, so the gap lies between two seconds.
    """
    e = event_rows(spark, sf_dir)
    timed = e.where("sec is not null").withColumn("ts", F.timestamp_seconds("sec"))
    s = timed.groupBy("user_id", F.session_window("ts", "3600500 milliseconds")).agg(F.count("*").alias("n"), F.min("sec").alias("first"), F.max("sec").alias("last"))
    alone = e.where("sec is null").select("user_id", F.col("sec").alias("first"), F.col("sec").alias("last"), F.lit(1).cast("long").alias("n"))
    return s.select("user_id", "first", "last", "n").unionByName(alone)


QUERIES = {f.__name__: f for f in (haversine_steps, avg_speed, walking_segment, stationary_cluster, location_staleness, recent_points, local_hour_reason, reason_display, leave_now, gap_window, gap_windows, audit_items, location_items, stream_sessions)}

_HAV = "2 * 6371000.0 * atan2(sqrt({a}), sqrt(greatest(1 - ({a}), 0)))"


def _haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2) + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2) * sin(radians({lon2} - {lon1}) / 2)"
    return _HAV.format(a=a)


STEPS_SQL = (
    "WITH "
    + POINTS_SQL
    + f""", st AS (
  SELECT *, lead(sec) OVER w AS osec, lead(lat) OVER w AS olat, lead(lon) OVER w AS olon, lead(velocity) OVER w AS ov, lag(sec) OVER w AS nsec,
    first_value(lat) OVER w AS lat0, first_value(lon) OVER w AS lon0, first_value(accuracy) OVER w AS acc0, row_number() OVER w AS i
  FROM pt WINDOW w AS (PARTITION BY user_id ORDER BY sec DESC, event_id DESC)
), sp AS (
  SELECT *, sec - osec AS gap, {_haversine('lat', 'lon', 'olat', 'olon')} AS metres FROM st
)"""
)
_SPEED = "coalesce(velocity, ov, CASE WHEN gap > 0 THEN metres / gap END)"
_FAR = f"{_haversine('lat0', 'lon0', 'lat', 'lon')} > CASE WHEN greatest(acc0, accuracy) >= 250 THEN greatest({RADIUS}, 1.5 * (acc0 + accuracy + 80)) ELSE {RADIUS} END"

ORACLES = {
    "haversine_steps": STEPS_SQL + " SELECT user_id, event_id, gap, round(metres, 2) AS metres FROM sp WHERE gap IS NOT NULL",
    "avg_speed": STEPS_SQL + f" SELECT user_id, round(avg({_SPEED}), 6) AS speed, count(*) AS n FROM sp GROUP BY user_id",
    "walking_segment": STEPS_SQL
    + f""", b AS (SELECT *, min(CASE WHEN nsec IS NOT NULL AND NOT (nsec - sec > 0 AND nsec - sec <= {GAP}) THEN i ELSE 1000000000 END) OVER (PARTITION BY user_id) AS stop FROM sp),
t AS (SELECT *, {_SPEED} AS s FROM b WHERE i < stop),
g AS (SELECT user_id, count(*) AS n, greatest(1, (max(sec) - min(sec)) // 60)::BIGINT AS minutes, avg(CASE WHEN i < stop - 1 AND osec IS NOT NULL THEN s END) AS speed,
  arg_max(lat, (sec, event_id)) AS a, arg_max(lon, (sec, event_id)) AS b, arg_min(lat, (sec, event_id)) AS c, arg_min(lon, (sec, event_id)) AS d FROM t GROUP BY user_id),
h AS (SELECT *, {_haversine('a', 'b', 'c', 'd')} AS net FROM g)
SELECT user_id, n, minutes, round(speed, 6) AS speed, round(net, 2) AS net FROM h WHERE n >= 2 AND speed BETWEEN 0.6 AND 2.2 AND minutes >= 5 AND net >= 1000""",
    "stationary_cluster": STEPS_SQL
    + f""", b AS (SELECT *, min(CASE WHEN {_FAR} THEN i ELSE 1000000000 END) OVER (PARTITION BY user_id) AS stop FROM st),
g AS (SELECT user_id, count(*) AS n, max(sec) AS newest, min(sec) AS oldest, max(acc0) AS acc0 FROM b WHERE i < stop GROUP BY user_id)
SELECT user_id, n, ((newest - oldest) // 60)::BIGINT AS minutes, newest, oldest FROM g WHERE (newest - oldest) // 60 >= CASE WHEN acc0 >= 250 AND n >= 3 THEN 10 ELSE 15 END""",
    "location_staleness": "WITH " + EVENTS_SQL + " SELECT user_id, max(sec) AS newest FROM ev GROUP BY user_id HAVING 1706659200 - max(sec) <= 5400",
    "recent_points": "WITH " + POINTS_SQL + " SELECT event_id, sec, round(CASE WHEN event_id % 4 = 0 THEN NULL ELSE velocity END, 6) AS velocity FROM pt ORDER BY sec DESC, event_id DESC LIMIT 240",
    "local_hour_reason": "WITH "
    + EVENTS_SQL
    + """, h AS (SELECT event_id, ((sec + 32400) % 86400 // 3600)::INTEGER AS hour FROM ev)
SELECT event_id, hour, CASE WHEN hour BETWEEN 11 AND 13 OR hour BETWEEN 17 AND 19 THEN 'meal_window' WHEN hour BETWEEN 14 AND 16 THEN 'snack_window' ELSE 'walking_nearby' END AS reason FROM h""",
    "reason_display": "WITH "
    + EVENTS_SQL
    + """, r AS (SELECT ['meal_window', 'snack_window', 'transient_stop', 'walking_nearby', 'stopped_moving', 'other'][k % 6 + 1] AS reason, user_id % 2 = 0 AS walking FROM ev)
SELECT reason, walking, CASE WHEN reason IN ('meal_window', 'snack_window', 'transient_stop') THEN reason WHEN walking THEN 'walking_nearby' ELSE 'stopped_moving' END AS shown, count(*) AS n FROM r GROUP BY ALL""",
    "leave_now": f"""
WITH o AS (SELECT *, epoch_us(o_orderdate) // 1000000 AS sec FROM orders),
d AS (SELECT *, sec - 600 * substr(o_orderpriority, 1, 1)::INTEGER AS departure, sec - sec % 86400 AS n FROM o)
SELECT o_custkey, o_orderkey, {ISO_SQL.format('departure')} AS departure FROM d WHERE n >= departure AND n < sec + 3600
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY departure, o_orderkey) = 1""",
    "gap_window": """
WITH o AS (SELECT o_custkey, epoch_us(o_orderdate) // 1000000 AS sec FROM orders),
g AS (SELECT o_custkey, max(CASE WHEN sec + 3600 <= 883612800 THEN sec + 3600 END) AS ended, min(CASE WHEN sec > 883612800 THEN sec END) AS starts FROM o GROUP BY 1)
SELECT o_custkey, ended, starts, (starts - 883612800) // 60 AS minutes FROM g WHERE ended IS NOT NULL AND (starts - 883612800) // 60 >= 30""",
    "gap_windows": """
WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 1000000 AS sec FROM orders),
g AS (SELECT *, max(sec + 3600) OVER (PARTITION BY o_custkey ORDER BY sec, o_orderkey ROWS UNBOUNDED PRECEDING) AS ended, lead(sec) OVER (PARTITION BY o_custkey ORDER BY sec, o_orderkey) AS nxt FROM o)
SELECT o_custkey, o_orderkey, (nxt - ended) // 60 AS minutes FROM g WHERE nxt - ended >= 1800""",
    "audit_items": "WITH " + EVENTS_SQL + " SELECT 'audit:' || user_id AS id, 'notification_rate: ' || count(*) || chr(10) || 'delivery_failures: ' || count_if(event_type = 'error') AS body FROM ev GROUP BY user_id",
    "location_items": "WITH "
    + POINTS_SQL
    + """ SELECT 'location:' || user_id AS id, 'primary: [' || printf('%.5f, %.5f', lat, lon) || '](https://maps.example.com/?q=' || event_id || ')' AS citation
FROM pt QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sec DESC, event_id DESC) = 1""",
    "stream_sessions": "WITH "
    + EVENTS_SQL
    + """, b AS (SELECT *, CASE WHEN sec - lag(sec) OVER w <= 3600 THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS n FROM b)
SELECT user_id, min(sec) AS first, max(sec) AS last, count(*) AS n FROM s GROUP BY user_id, s.n""",
}

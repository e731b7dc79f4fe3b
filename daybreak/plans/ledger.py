"""Ledger, cursor, suppression and state queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybreak.functions.text import fingerprint, identity, subject_key
from daybreak.functions.times import cooldown_expiry, iso, natural_key, seconds
from daybreak.operators import state
from daybreak.operators.bindings import EVENTS_SQL, ITEMS_SQL, document_items, event_rows, page_items
from daybreak.operators.dedupe import first_wins, heaviest_wins, last_value_first_place, ledger_diff, ledger_state
from daybreak.session import table


#: What the first batch holds; the second one holds all documents.
FIRST_BATCH = "lang <> 'en'"


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ledger rows: the text's hash as identity, the title and place as what may change."""
    items = document_items(spark, sf_dir)
    return items.select("source", F.sha2("body", 256).alias("identity"), fingerprint(F.col("title"), F.col("tier")).alias("fingerprint"), F.col("doc_id").alias("pos"), "id", "lang")


BATCH_SQL = (
    "WITH "
    + ITEMS_SQL
    + """, b AS (SELECT 'all' AS source, sha256(body) AS identity, sha256('=' || title || chr(31) || '=' || tier) AS fingerprint, doc_id AS pos, id, lang FROM items)"""
)


def _merged(batch: DataFrame) -> DataFrame:
    return batch.withColumn("source", F.lit("all"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).select("id", "identity", "fingerprint")


def ledger_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_wins(_merged(_batch(spark, sf_dir)).where(FIRST_BATCH), ["source", "identity"], "pos").select("id", "identity", "fingerprint")


def ledger_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second batch (all documents) adds to the ledger of the first (those in other languages than English)."""
    batch = _merged(_batch(spark, sf_dir))
    ledger = first_wins(batch.where(FIRST_BATCH), ["source", "identity"], "pos").withColumn("seq", F.col("pos"))
    return ledger_diff(batch, ledger_state(ledger)).select("id", "identity", "fingerprint")


def ledger_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose identity isn't among those of the first batch."""
    batch = _merged(_batch(spark, sf_dir))
    return batch.join(batch.where(FIRST_BATCH).select("identity").distinct(), "identity", "left_anti").select("id", "identity")


def identity_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_items(spark, sf_dir).withColumn("identity", identity(F.regexp_replace("url", r"[?#].*$", ""), F.lit(None).cast("string"), F.col("id")))
    return first_wins(pages, ["identity"], "page_id").select("id", "identity")


def heaviest_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by address without its query: the heaviest text, at the place of the address's first page."""
    pages = page_items(spark, sf_dir).select("page_id", F.when(F.col("page_id") % 10 != 0, F.regexp_replace("url", r"^([a-z]+://[^/?#]+).*$", "$1")).alias("address"), (F.length("title") + F.length("body")).alias("weight"))
    out = heaviest_wins(pages, "address", F.col("weight"), "page_id")
    return out.select("page_id", "address", F.col("weight").cast("long"), "keyed", F.col("first_pos"))


def passthrough_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, which have no address to be deduped by, then the first page of every host, with their order."""
    docs = document_items(spark, sf_dir).select("id", F.lit(0).alias("part"), F.col("doc_id").alias("pos"))
    pages = first_wins(page_items(spark, sf_dir), ["source"], "page_id").select("id", F.lit(1).alias("part"), F.col("page_id").alias("pos"))
    return docs.unionByName(pages)


def ledger_replay_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 2024-01-10 up to 2024-01-12, the end excluded, in replay order."""
    e = event_rows(spark, sf_dir).where("sec >= 1704844800 and sec < 1705017600")
    order = Window.partitionBy("event_type").orderBy("sec", "event_id")
    return e.select("event_type", F.row_number().over(order).alias("place"), "event_id", iso(F.col("sec")).alias("retrieved_at"))


def replay_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a replay of the window writes: the last row of each user in it."""
    e = event_rows(spark, sf_dir).where("sec >= 1704844800 and sec < 1705017600")
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("sec", "event_id")).alias("event_id"), F.count("*").alias("n"))


def _cursors(e: DataFrame) -> DataFrame:
    """Each type's largest id up to 2024-01-15."""
    return e.where("sec <= 1705276800").groupBy(F.col("event_type").alias("source")).agg(F.max("event_id").alias("cursor"), F.max("sec").alias("last_success"))


def cursor_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_rows(spark, sf_dir)
    items = e.select(F.col("event_type").alias("source"), F.when(F.col("k") != 7, F.col("event_id")).alias("raw_id"), "event_id", (F.col("sec") + F.when(F.col("k") == 9, 2592000).otherwise(0)).alias("changed_at"))
    return state.after_cursor(items, _cursors(e)).select("source", "event_id")


def cursor_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cursors after the whole table; they never move back."""
    e = event_rows(spark, sf_dir)
    new = e.groupBy(F.col("event_type").alias("source")).agg(F.max_by("event_id", natural_key(F.col("event_id").cast("string"))).alias("seen"), F.max("sec").alias("polled_at"))
    return new.join(_cursors(e), "source", "left").select("source", F.greatest("seen", "cursor").alias("cursor"), "polled_at")


def natural_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).when(F.col("doc_id") % 3 == 1, F.concat(F.col("lang"), F.lit("-"), F.col("doc_id"))).otherwise(F.concat(F.col("source"), F.lit("x")))
    keyed = d.select("doc_id", "lang", raw.alias("raw")).withColumn("key", natural_key(F.col("raw")))
    best = keyed.groupBy("lang").agg(F.max("key").alias("top"), F.min("key").alias("low"))
    return best.select("lang", F.col("top.raw").alias("largest"), F.col("low.raw").alias("smallest"), F.col("top.rank").alias("top_rank"))


def _subject() -> Column:
    """The key of a source and an id."""
    return subject_key(F.concat(F.lit("s"), F.col("user_id") % 3), F.col("user_id").cast("string"))


def _suppressions(e: DataFrame) -> DataFrame:
    """Deliveries of the first ten days as suppression rows."""
    status = F.when(F.col("k") % 11 == 0, "dismissed").when(F.col("k") % 13 == 0, "expired").otherwise("active")
    minutes = F.when(F.col("k") % 17 == 0, None).otherwise(F.col("k") * 60)
    expiry = F.when(F.col("k") % 19 != 0, cooldown_expiry(F.col("sec"), minutes))
    return e.where("sec < 1704931200").select(F.col("event_type").alias("family"), _subject().alias("subject"), status.alias("status"), (F.col("k") % 23 == 0).alias("superseded"), expiry.alias("expires_at"))


SUPPRESSION_SQL = (
    "WITH "
    + EVENTS_SQL
    + """, h AS (
  SELECT event_type AS family, '["s' || (user_id % 3) || '","' || user_id || '"]' AS subject, CASE WHEN k % 11 = 0 THEN 'dismissed' WHEN k % 13 = 0 THEN 'expired' ELSE 'active' END AS status,
    k % 23 = 0 AS superseded, CASE WHEN k % 19 <> 0 THEN sec + 60 * CASE WHEN k % 17 = 0 THEN 1440 ELSE k * 60 END END AS expires_at
  FROM ev WHERE sec < 1704931200
), act AS (
  SELECT DISTINCT family, subject FROM h WHERE status = 'active' AND NOT superseded AND (expires_at IS NULL OR expires_at >= 1704931200)
)"""
)


def active_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _suppressions(event_rows(spark, sf_dir))
    live = (F.col("status") == "active") & ~F.col("superseded") & (F.col("expires_at").isNull() | (F.col("expires_at") >= 1704931200))
    return h.where(live).select("family", "subject").distinct()


def suppression_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks after the first ten days whose (source, user) isn't suppressed for clicks."""
    e = event_rows(spark, sf_dir)
    subjects = state.active_suppressions(_suppressions(e), "click", F.lit(1704931200))
    return e.where("event_type = 'click' and sec >= 1704931200").withColumn("subject", _subject()).join(subjects, "subject", "left_anti").select("event_id", "user_id")


def cooldown_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are delivered under a cooldown of six hours per (type, user)."""
    return state.greedy_cooldown(event_rows(spark, sf_dir), ["event_type", "user_id"], "sec", "event_id", 360)


def cooldown_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come later than six hours after the one before, delivered or not."""
    before = F.lag("sec").over(Window.partitionBy("event_type", "user_id").orderBy("sec", "event_id"))
    e = event_rows(spark, sf_dir).withColumn("before", before)
    return e.where(F.col("before").isNull() | (F.col("sec") > F.col("before") + 21600)).select("event_type", "user_id", "event_id")


def cooldown_expiries(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.when(F.col("k") % 10 == 0, 0).when(F.col("k") % 10 == 1, None).otherwise(F.col("k"))
    return event_rows(spark, sf_dir).select("event_id", iso(cooldown_expiry(F.col("sec"), minutes)).alias("expires_at"))


def feedback_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_rows(spark, sf_dir)
    signal = F.when(F.col("value") > 50, "up").otherwise("down")
    return e.groupBy(F.col("event_type").alias("category"), (F.col("k") % 5).alias("subject"), signal.alias("signal")).agg(F.count("*").cast("string").alias("total"))


def audit_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user audit figures as long rows; null figures give none, lists one row for each entry."""
    e = event_rows(spark, sf_dir)
    errors = F.col("event_type") == "error"
    wide = e.groupBy("user_id").agg(F.count("*").alias("notification_rate"), F.nullif(F.count_if(errors), F.lit(0)).alias("delivery_failures"), F.array_sort(F.collect_set(F.when(F.col("k") >= 95, F.col("event_type")))).alias("late"))
    scalars = wide.unpivot(["user_id"], ["notification_rate", "delivery_failures"], "signal", "value").where("value is not null").select("user_id", "signal", F.col("value").cast("string").alias("value"))
    return scalars.unionByName(wide.select("user_id", F.lit("late_trigger").alias("signal"), F.explode("late").alias("value")))


def _polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, line = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    polls = line.groupBy("l_suppkey").agg(F.max(seconds("l_shipdate")).alias("last"))
    polled = F.when(F.col("s_acctbal") >= 0, F.col("last"))  # a supplier in debt stands for one that was never polled
    return s.join(polls, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", "s_name", polled.alias("polled_at"))


POLLS_SQL = """
WITH p AS (
  SELECT s_suppkey, s_name, CASE WHEN s_acctbal >= 0 THEN last END AS polled_at FROM supplier LEFT JOIN (
    SELECT l_suppkey, max(epoch_us(l_shipdate) // 1000000) AS last FROM lineitem GROUP BY 1
  ) ON s_suppkey = l_suppkey
)"""
NOW = 1004832000  # 2001-11-04


def staleness_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = F.col("polled_at") < NOW - 2 * 86400
    report = F.when(F.col("polled_at").isNull(), F.concat("s_name", F.lit(": never_polled"))).when(stale, F.concat("s_name", F.lit(": stale_since="), iso(F.col("polled_at"))))
    return _polls(spark, sf_dir).select("s_suppkey", report.alias("report")).where("report is not null")


def registry_state_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items give their ids, a success without any gives none, an error keeps the old ids, what wasn't observed stays as it is.

    The events of type click are the observed items, dealt over all sources.
    """
    polls = _polls(spark, sf_dir)
    sources = F.lit(max(1, table(spark, sf_dir, "supplier").count()))
    clicks = F.count_if(F.col("event_type") == "click")
    seen = event_rows(spark, sf_dir).groupBy((F.col("user_id") % sources + 1).alias("key")).agg(clicks.alias("n"))
    outcome = F.when(F.col("n") > 0, "items").when(F.col("s_suppkey") % 4 == 0, "success").when(F.col("s_suppkey") % 4 == 1, "error").otherwise("unobserved")
    rows = polls.join(seen, F.col("s_suppkey") == F.col("key"), "left").withColumn("outcome", outcome)
    ids = F.when(F.col("outcome") == "items", F.col("n")).when(F.col("outcome") == "success", 0).otherwise(F.col("s_suppkey"))
    return rows.select("s_suppkey", "outcome", ids.cast("long").alias("n_ids"), (F.col("outcome") == "error").alias("has_error"))


def connector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursor rows of two polls: a null cursor keeps the old one, the other columns are overwritten."""
    e = event_rows(spark, sf_dir)
    old = e.where("sec < 1705276800").groupBy("user_id").agg(F.max("event_id").alias("cursor"), F.max("sec").alias("polled_at"))
    new = e.where("sec >= 1705276800").groupBy("user_id").agg(F.max(F.when(F.col("k") > 90, F.col("event_id"))).alias("cursor"), F.max("sec").alias("polled_at"))
    return state.upsert(old, new, "user_id", ("cursor",))


def _approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    first = F.when(F.col("o_orderkey") % 3 == 0, "reject").otherwise("approve")
    second = F.when(F.col("o_orderstatus") == "P", None).when(F.col("o_orderkey") % 2 == 0, "complete").otherwise("fail")
    one = state.transition(F.lit("pending"), first, state.APPROVAL)
    two = state.transition(F.col("one"), F.col("second"), state.APPROVAL)
    return o.select("o_orderkey", "o_orderstatus", "o_orderdate", first.alias("first"), second.alias("second"), one.alias("one")).withColumn("two", two)


def approval_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commands on every pending action; a command that the state doesn't allow is rejected and changes nothing."""
    rows = _approvals(spark, sf_dir)
    return rows.select("o_orderkey", F.coalesce("two", "one").alias("state"), (F.col("second").isNotNull() & F.col("two").isNull()).alias("second_rejected"))


def suppression_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    start = F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "dismissed").otherwise("expired")
    command = F.when(F.col("o_orderkey") % 3 == 0, "dismiss").when(F.col("o_orderkey") % 3 == 1, "expire").otherwise("supersede")
    rows = o.select("o_orderkey", start.alias("before"), command.alias("command"))
    after = state.transition(F.col("before"), F.col("command"), state.SUPPRESSION)
    return rows.select("o_orderkey", F.coalesce(after, F.col("before")).alias("state"), ((F.col("before") == "active") & (F.col("command") == "supersede")).alias("superseded"))


def recent_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 last recorded actions."""
    rows = _approvals(spark, sf_dir).select("o_orderkey", iso(seconds("o_orderdate")).alias("recorded_at"), F.coalesce("two", "one").alias("state"))
    return rows.orderBy(F.desc("recorded_at"), F.desc("o_orderkey")).limit(20)


def state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursors = _cursors(event_rows(spark, sf_dir)).select(F.lit("cursor").alias("part"), F.col("source").alias("name"), F.col("cursor").cast("string").alias("value"))
    actions = _approvals(spark, sf_dir).groupBy(F.coalesce("two", "one").alias("name")).agg(F.count("*").cast("string").alias("value")).select(F.lit("action").alias("part"), "name", "value")
    return cursors.unionByName(actions)


def registry_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of all sources and an included one that has some of them again: each id at its first place with its last value."""
    s = table(spark, sf_dir, "supplier")
    one = s.select("s_suppkey", F.col("s_name").alias("title"), F.col("s_suppkey").alias("pos"))
    two = s.where("s_nationkey < 13").select("s_suppkey", F.concat("s_name", F.lit(" v2")).alias("title"), (F.col("s_suppkey") + 1000000).alias("pos"))
    return last_value_first_place(one.unionByName(two), "s_suppkey", "pos")


APPROVALS_SQL = """
WITH a AS (
  SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN 'rejected' ELSE 'approved' END AS one,
    CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 2 = 0 THEN 'complete' ELSE 'fail' END AS second FROM orders
), t AS (
  SELECT *, CASE WHEN one = 'approved' AND second = 'complete' THEN 'executed' WHEN one = 'approved' AND second = 'fail' THEN 'failed' END AS two FROM a
)"""

QUERIES = {
    f.__name__: f
    for f in (fingerprints, ledger_initial, ledger_changes, ledger_antijoin, identity_dedupe, heaviest_dedupe, passthrough_union, ledger_replay_window, replay_overwrite, cursor_filter, cursor_advance, natural_sort_key, active_subjects, suppression_filter, cooldown_greedy, cooldown_lag, cooldown_expiries, feedback_totals, audit_unpivot, staleness_audit, registry_state_transition, connector_upsert, approval_machine, suppression_machine, recent_actions, state_summary, registry_load)
}
ISO_SQL = "strftime(make_timestamp({} * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
#: The character references that the tables hold, `&amp` last; a semicolon may be missing.
REFERENCES = (("&copy;?", "©"), ("&middot;?", "·"), ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "''"), ("&amp;?", "&"))


def plain_sql(html: str) -> str:
    """The text of HTML without its tags in one line."""
    out = f"regexp_replace({html}, '<[^>]+>', ' ', 'g')"
    for reference, char in REFERENCES:
        out = f"regexp_replace({out}, '{reference}', '{char}', 'g')"
    return rf"trim(regexp_replace({out}, '[\s\v\pZ\x1c-\x1f\x85]+', ' ', 'g'))"


PAGES_SQL = rf"""
WITH pg AS (
  SELECT page_id, 'page:' || page_id AS id, url, lower(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1), '')) AS source,
    nullif({plain_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '') AS title,
    {plain_sql("html")} AS body
  FROM pages
)"""
ORACLES = {
    "fingerprints": BATCH_SQL + " SELECT id, identity, fingerprint FROM b",
    "ledger_initial": BATCH_SQL + " SELECT id, identity, fingerprint FROM b WHERE lang <> 'en' QUALIFY row_number() OVER (PARTITION BY identity ORDER BY pos) = 1",
    "ledger_changes": BATCH_SQL
    + """, l AS (SELECT identity, fingerprint FROM b WHERE lang <> 'en' QUALIFY row_number() OVER (PARTITION BY identity ORDER BY pos) = 1),
f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY identity ORDER BY pos) = 1)
SELECT id, identity, fingerprint FROM f ANTI JOIN l USING (identity, fingerprint)""",
    "ledger_antijoin": BATCH_SQL + " SELECT id, identity FROM b WHERE identity NOT IN (SELECT identity FROM b WHERE lang <> 'en')",
    "identity_dedupe": PAGES_SQL + r" SELECT id, regexp_replace(url, '[?#].*$', '') AS identity FROM pg QUALIFY row_number() OVER (PARTITION BY identity ORDER BY page_id) = 1",
    "heaviest_dedupe": PAGES_SQL
    + r""", w AS (SELECT page_id, CASE WHEN page_id % 10 <> 0 THEN regexp_replace(url, '^([a-z]+://[^/?#]+).*$', '\1') END AS address, length(title) + length(body) AS weight FROM pg)
SELECT page_id, address, weight::BIGINT AS weight, 0 AS keyed, page_id AS first_pos FROM w WHERE address IS NULL
UNION ALL SELECT arg_max(page_id, (weight, -page_id)), address, max(weight)::BIGINT, 1, min(page_id) FROM w WHERE address IS NOT NULL GROUP BY address""",
    "passthrough_union": PAGES_SQL
    + """ SELECT 'doc:' || doc_id AS id, 0 AS part, doc_id AS pos FROM documents
UNION ALL (SELECT id, 1, page_id FROM pg QUALIFY row_number() OVER (PARTITION BY source ORDER BY page_id) = 1)""",
    "ledger_replay_window": "WITH " + EVENTS_SQL + f" SELECT event_type, (row_number() OVER (PARTITION BY event_type ORDER BY sec, event_id))::INTEGER AS place, event_id, {ISO_SQL.format('sec')} AS retrieved_at FROM ev WHERE sec >= 1704844800 AND sec < 1705017600",
    "replay_overwrite": "WITH " + EVENTS_SQL + " SELECT user_id, arg_max(event_id, (sec, event_id)) AS event_id, count(*) AS n FROM ev WHERE sec >= 1704844800 AND sec < 1705017600 GROUP BY user_id",
    "cursor_filter": "WITH "
    + EVENTS_SQL
    + """, c AS (SELECT event_type, max(event_id) AS cursor, max(sec) AS last FROM ev WHERE sec <= 1705276800 GROUP BY 1)
SELECT event_type AS source, event_id FROM ev LEFT JOIN c USING (event_type)
WHERE k = 7 OR cursor IS NULL OR sec + CASE WHEN k = 9 THEN 2592000 ELSE 0 END > last OR event_id > cursor""",
    "cursor_advance": "WITH " + EVENTS_SQL + " SELECT event_type AS source, max(event_id) AS cursor, max(sec) AS polled_at FROM ev GROUP BY 1",
    "natural_sort_key": r"""
WITH r AS (SELECT lang, CASE doc_id % 3 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN lang || '-' || doc_id ELSE source || 'x' END AS raw FROM documents),
k AS (SELECT lang, raw, CASE WHEN regexp_matches(raw, '^[0-9]+$') THEN 2 WHEN regexp_matches(raw, '[0-9]$') THEN 1 ELSE 0 END AS rank,
  CASE WHEN regexp_matches(raw, '[0-9]$') THEN regexp_extract(raw, '^(.*?)[0-9]+$', 1) ELSE raw END AS prefix, coalesce(TRY_CAST(regexp_extract(raw, '([0-9]+)$', 1) AS BIGINT), -1) AS number FROM r)
SELECT lang, arg_max(raw, (rank, prefix, number, raw)) AS largest, arg_min(raw, (rank, prefix, number, raw)) AS smallest, max(rank)::INTEGER AS top_rank FROM k GROUP BY lang""",
    "active_subjects": SUPPRESSION_SQL + " SELECT family, subject FROM act",
    "suppression_filter": SUPPRESSION_SQL
    + """ SELECT event_id, user_id FROM ev WHERE event_type = 'click' AND sec >= 1704931200
AND '["s' || (user_id % 3) || '","' || user_id || '"]' NOT IN (SELECT subject FROM act WHERE family = 'click')""",
    "cooldown_greedy": "WITH RECURSIVE "
    + EVENTS_SQL
    + """, o AS (SELECT event_type, user_id, event_id, sec, row_number() OVER (PARTITION BY event_type, user_id ORDER BY sec, event_id) AS n FROM ev),
g AS (
  SELECT event_type, user_id, event_id, n, sec + 21600 AS until, true AS sent FROM o WHERE n = 1
  UNION ALL
  SELECT o.event_type, o.user_id, o.event_id, o.n, CASE WHEN o.sec > g.until THEN o.sec + 21600 ELSE g.until END, o.sec > g.until
  FROM g JOIN o ON o.event_type = g.event_type AND o.user_id = g.user_id AND o.n = g.n + 1
) SELECT event_type, user_id, event_id FROM g WHERE sent""",
    "cooldown_lag": "WITH " + EVENTS_SQL + ", l AS (SELECT *, lag(sec) OVER (PARTITION BY event_type, user_id ORDER BY sec, event_id) AS b FROM ev) SELECT event_type, user_id, event_id FROM l WHERE b IS NULL OR sec > b + 21600",
    "cooldown_expiries": "WITH " + EVENTS_SQL + f" SELECT event_id, {ISO_SQL.format('(sec + 60 * CASE WHEN k % 10 = 0 THEN 0 WHEN k % 10 = 1 THEN 1440 ELSE k END)')} AS expires_at FROM ev",
    "feedback_totals": "WITH " + EVENTS_SQL + " SELECT event_type AS category, k % 5 AS subject, CASE WHEN value > 50 THEN 'up' ELSE 'down' END AS signal, count(*)::VARCHAR AS total FROM ev GROUP BY ALL",
    "audit_unpivot": "WITH "
    + EVENTS_SQL
    + """ SELECT user_id, 'notification_rate' AS signal, count(*)::VARCHAR AS value FROM ev GROUP BY user_id
UNION ALL SELECT user_id, 'delivery_failures', count(*)::VARCHAR FROM ev WHERE event_type = 'error' GROUP BY user_id
UNION ALL SELECT DISTINCT user_id, 'late_trigger', event_type FROM ev WHERE k >= 95""",
    "staleness_audit": POLLS_SQL
    + f""" SELECT s_suppkey, CASE WHEN polled_at IS NULL THEN s_name || ': never_polled' ELSE s_name || ': stale_since=' || {ISO_SQL.format('polled_at')} END AS report
FROM p WHERE polled_at IS NULL OR polled_at < {NOW} - 172800""",
    "registry_state_transition": POLLS_SQL
    + """, u AS (SELECT user_id % (SELECT greatest(1, count(*)) FROM supplier) + 1 AS key, count_if(event_type = 'click') AS n FROM events GROUP BY 1),
o AS (SELECT s_suppkey, n, CASE WHEN n > 0 THEN 'items' WHEN s_suppkey % 4 = 0 THEN 'success' WHEN s_suppkey % 4 = 1 THEN 'error' ELSE 'unobserved' END AS outcome FROM p LEFT JOIN u ON s_suppkey = key)
SELECT s_suppkey, outcome, (CASE outcome WHEN 'items' THEN n WHEN 'success' THEN 0 ELSE s_suppkey END)::BIGINT AS n_ids, outcome = 'error' AS has_error FROM o""",
    "connector_upsert": "WITH "
    + EVENTS_SQL
    + """, o AS (SELECT user_id, max(event_id) AS cursor, max(sec) AS polled_at FROM ev WHERE sec < 1705276800 GROUP BY 1),
n AS (SELECT user_id, max(CASE WHEN k > 90 THEN event_id END) AS cursor, max(sec) AS polled_at FROM ev WHERE sec >= 1705276800 GROUP BY 1)
SELECT coalesce(o.user_id, n.user_id) AS user_id, CASE WHEN n.user_id IS NOT NULL THEN coalesce(n.cursor, o.cursor) ELSE o.cursor END AS cursor,
  CASE WHEN n.user_id IS NOT NULL THEN n.polled_at ELSE o.polled_at END AS polled_at FROM o FULL JOIN n ON o.user_id = n.user_id""",
    "approval_machine": APPROVALS_SQL + " SELECT o_orderkey, coalesce(two, one) AS state, second IS NOT NULL AND two IS NULL AS second_rejected FROM t",
    "suppression_machine": """
WITH s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'dismissed' ELSE 'expired' END AS b, o_orderkey % 3 AS c FROM orders)
SELECT o_orderkey, CASE WHEN b = 'active' AND c = 0 THEN 'dismissed' WHEN b = 'active' AND c = 1 THEN 'expired' ELSE b END AS state, b = 'active' AND c = 2 AS superseded FROM s""",
    "recent_actions": APPROVALS_SQL + f" SELECT o_orderkey, {ISO_SQL.format('(epoch_us(o_orderdate) // 1000000)')} AS recorded_at, coalesce(two, one) AS state FROM t ORDER BY recorded_at DESC, o_orderkey DESC LIMIT 20",
    "state_summary": APPROVALS_SQL
    + ", "
    + EVENTS_SQL
    + """ SELECT 'cursor' AS part, event_type AS name, max(event_id)::VARCHAR AS value FROM ev WHERE sec <= 1705276800 GROUP BY event_type
UNION ALL SELECT 'action', coalesce(two, one), count(*)::VARCHAR FROM t GROUP BY 2""",
    "registry_load": """
SELECT s_suppkey, CASE WHEN s_nationkey < 13 THEN s_name || ' v2' ELSE s_name END AS title, s_suppkey AS pos FROM supplier
""",
}

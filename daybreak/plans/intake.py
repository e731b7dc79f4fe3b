"""Queries of the export readers, registries, payloads and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybreak.functions import text, times
from daybreak.operators import state
from daybreak.operators.bindings import EVENTS_SQL, ITEMS_SQL, document_items, event_rows, page_items
from daybreak.plans.ledger import ISO_SQL, PAGES_SQL
from daybreak.session import table
from daybreak.sources import arrays, exports
from daybreak.sources import items as sources
from daybreak.summary import compact_items, notice


def _quoted(value: Column) -> Column:
    """A text as JSON."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _conversation_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as maps of nodes: content as a text, as parts, as a text's value or as a text field, some nodes without a message or role."""
    c = table(spark, sf_dir, "conversations")
    body, form = _quoted(F.coalesce("text", F.lit(""))), F.col("turn") % 4
    content = (
        F.when(form == 0, body)
        .when(form == 1, F.concat(F.lit('{"parts":[" ",'), body, F.lit(",7]}")))
        .when(form == 2, F.concat(F.lit('{"parts":[],"text":{"value":'), body, F.lit("}}")))
        .otherwise(F.concat(F.lit('{"text":'), body, F.lit("}")))
    )
    at = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(',"create_time":'), F.col("turn").cast("string"))).otherwise(F.lit(""))
    message = F.concat(F.lit('"message":{"author":{"role":'), _quoted(F.coalesce("role", F.lit(""))), F.lit('},"content":'), content, at, F.lit("}"))
    node = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("{"), message, F.lit(',"create_time":'), F.col("turn").cast("string"), F.lit(".5}"))).otherwise(F.concat(F.lit("{"), message, F.lit("}")))
    entry = F.concat(F.lit('"n'), F.col("turn").cast("string"), F.lit('":'), node)
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", entry.alias("entry")))), lambda x: x.entry)
    return c.groupBy("conv_id").agg(F.array_join(nodes, ",").alias("nodes")).select(F.concat(F.lit('{"id":"c'), "conv_id", F.lit('","title":"t","create_time":1700000000.25,"mapping":{"none":null,"odd":7,"empty":{},'), "nodes", F.lit("}}")).alias("payload"))


def conversation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a conversation export: times that are numbers first, then nodes without one in the map's order."""
    return exports.conversation_export(_conversation_payloads(spark, sf_dir)).select("id", F.sha2("body", 256).alias("digest"), "message_count", "created_at")


def response_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index LEFT JOIN response files: every third conversation has no file, every fourth response is blank."""
    c = table(spark, sf_dir, "conversations").withColumn("cid", F.concat(F.lit("r"), "conv_id"))
    index = c.select("cid").distinct().select(F.to_json(F.struct(F.col("cid").alias("conversationId"), F.lit("t").alias("title"))).alias("payload"))
    message = F.when(F.col("turn") % 4 == 3, F.lit("  ")).otherwise(F.coalesce("text", F.lit("")))
    row = F.struct("turn", F.col("role").alias("sender"), message.alias("message"))
    files = c.where("conv_id % 3 <> 2").groupBy(F.col("cid").alias("id")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(row)).alias("responses"))).alias("payload"))
    return exports.response_items(index, files).select("id", F.sha2("body", 256).alias("digest"), "response_count")


_AWKWARD = '"}],[{\\'


def array_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array of each source's documents, given in pieces between closing braces as a file's reader gives it; texts end with brackets, a quote and a backslash."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("file"), F.to_json(F.struct("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(_AWKWARD)).alias("text"))).alias("record"))
    ends = d.groupBy("file").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    part = lambda doc: F.floor(doc / 4096)
    cut = F.split(F.concat(F.when(F.col("doc_id") == F.col("first"), "[").otherwise(","), "record"), "[}]")
    inner = d.join(ends, "file").select("file", part(F.col("doc_id")).alias("part"), "doc_id", F.posexplode(F.slice(cut, 1, F.size(cut) - 1)).alias("spot", "value"))
    closing = ends.select("file", part(F.col("last") + 1).alias("part"), (F.col("last") + 1).alias("doc_id"), F.lit(0).alias("spot"), F.lit("]").alias("value"))
    found = arrays.elements(inner.unionByName(closing).select("file", "part", F.struct("doc_id", "spot").alias("seat"), "value"))
    return found.select(F.col("file").alias("source"), F.col("record").alias("place"), F.from_json("payload", "doc_id long, text string").alias("d")).select("source", "place", "d.doc_id", F.sha2("d.text", 256).alias("digest"))


def typed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = document_items(spark, sf_dir)
    intent = F.when(F.col("doc_id") % 2 == 0, F.struct("saved"))
    source = F.when(F.col("doc_id") % 11 != 0, F.col("source"))
    payload = F.to_json(F.struct("id", source.alias("source"), F.col("kind").alias("source_kind"), "title", F.array(F.lit("p")).alias("people"), intent.alias("intent_signals")))
    broken = F.when(F.col("doc_id") % 13 == 0, F.lit("not json")).otherwise(payload)
    out = exports.typed_items(items.select(broken.alias("payload")))
    return out.select("id", "source", F.size("people").alias("people"), F.size("topics").alias("topics"), F.col("intent_signals.saved").alias("saved"), F.col("intent_signals.unread").alias("unread"))


def ledger_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger lines of 2024-01-10 up to 2024-01-12, the end excluded; malformed and blank lines are skipped."""
    e = event_rows(spark, sf_dir)
    record = F.struct(F.concat(F.lit("e"), "event_id").alias("id"), F.col("event_type").alias("source"), F.lit("event").alias("source_kind"), F.lit("a\u2028b").alias("title"), F.when(F.col("k") % 7 != 0, times.iso(F.col("sec"))).alias("retrieved_at"))
    line = F.when(F.col("k") % 10 == 0, F.lit('{"id":')).when(F.col("k") % 10 == 1, F.lit("  ")).otherwise(exports.jsonl(record))
    return exports.ledger_items(e.select(line.alias("value")), "2024-01-10", "2024-01-12").select("id", "source", "retrieved_at", (F.col("title") == "a\u2028b").alias("whole"))


def visit_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of a browser's history; other addresses on the site don't count."""
    e = event_rows(spark, sf_dir)
    form = F.col("k") % 4
    url = F.concat(F.lit("https://grok.com/"), F.when(form == 3, F.lit("settings")).otherwise(F.concat(F.lit("c/u"), "user_id")), F.when(form == 1, F.concat(F.lit("?x=1&rid=r"), F.col("k") % 3)).when(form == 2, F.lit("?y=2#z")).otherwise(F.lit("")))
    title = F.when(F.col("k") % 5 == 0, F.lit("Grok")).when(F.col("k") % 5 == 1, F.lit("  ")).otherwise(F.concat(F.lit(" T"), "event_id", F.lit(" - Grok ")))
    visits = e.select(F.col("event_id").alias("id"), url.alias("url"), title.alias("title"), (F.col("sec") * 1000000 + 11644473600000000).alias("last_visit_time"), (F.col("k") % 6).alias("visit_count"))
    out = exports.visit_conversations(visits)
    return out.select("conversation_id", "canonical_url", F.array_join("url_variants", " ").alias("variants"), "visit_count", "modified_at", "title")


def signal_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of two signals from one response for each type of event, at most 100 a response."""
    e = event_rows(spark, sf_dir)
    posts = F.transform(F.array_sort(F.collect_list("event_id")), lambda i: F.struct(i.cast("string").alias("id"), F.concat(F.lit("post "), i).alias("text"), (i % 5).cast("string").alias("author_id")))
    users = F.array(*(F.struct(F.lit(str(n)).alias("id"), F.lit(f"user{n}").alias("username")) for n in range(3)))
    response = F.to_json(F.struct(F.slice(posts, 1, 150).alias("data"), F.struct(users.alias("users")).alias("includes"))).alias("payload")
    pages = lambda kind: e.where(F.col("event_type") == kind).groupBy("event_type").agg(response).select("payload")
    return exports.signal_posts({"bookmarks": pages("click"), "likes": pages("view")}).select("source", "pos", "id", "username")


def registry_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry limited to listed ids, in the list's order: here the suppliers of every third customer's number, backwards."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    rows = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.col("s_suppkey").cast("int").alias("pos"))
    again = rows.withColumns({"title": F.concat("title", F.lit(" v2")), "pos": F.col("pos") + 1000000}).where("id % 2 = 0")
    only = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), (-F.col("c_custkey")).cast("int").alias("place"))
    return exports.registry_rows(rows.unionByName(again), only).select("id", "title", F.col("pos.place").alias("place"))


def registry_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    rows = s.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.lit("ai")).when(F.col("s_suppkey") % 3 == 0, F.lit("")).alias("category_hint"), F.when(F.col("s_suppkey") % 5 == 0, F.array(F.lit("car"), F.lit("it"))).otherwise(F.array().cast("array<string>")).alias("topical_scopes"))
    return rows.select("s_suppkey", F.to_json(exports.category_metadata()).alias("metadata"))


def search_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of mode known_source_search by route: direct where there is a list of addresses, even an empty one, else search."""
    s = table(spark, sf_dir, "supplier")
    mode = F.when(F.col("s_suppkey") % 5 != 0, "known_source_search").otherwise("feed")
    registry = s.select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.lit("example.com").alias("domain"), mode.alias("acquisition_mode"))
    urls = F.when(F.col("s_suppkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("https://www.example.com/a-"), "s_suppkey"), F.lit("https://other.org/x"), F.lit("https://example.com/b_c")))
    direct = s.where("s_suppkey % 3 <> 0").select(F.concat(F.lit("s"), "s_suppkey").alias("source"), urls.alias("urls"))
    results = s.select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit('<a class="result__a" href="//search.example.com/l/?uddg=https%3A%2F%2Fexample.com%2Fr'), "s_suppkey", F.lit('">R</a><div class="result__snippet">S</div>')).alias("html"))
    return sources.known_source_items(registry, direct, results).select("source", "route", "rank", "title", "url")


def prefix_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations of a sitemap below a prefix, in document order."""
    pages = table(spark, sf_dir, "pages").groupBy((F.col("page_id") % 10).alias("map")).agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("p"))
    payload = F.concat(F.lit("<urlset>"), F.array_join(F.transform("p", lambda x: F.concat(F.lit("<url><loc> "), F.replace(x.url, F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))), ""), F.lit("</urlset>"))
    return sources.sitemap_prefix(pages.select("map", payload.alias("payload")), "map", "https://")


def prompt_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a prompt gets of each source: its first 50 items, shortened, beside the counts of all, included and omitted."""
    items = document_items(spark, sf_dir).withColumns({"excerpt": F.lit(None).cast("string"), "url": F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://d.example/"), "doc_id")), "start_at": F.lit(None).cast("string")})
    return compact_items(items.withColumn("title", F.when(F.col("doc_id") % 3 != 0, F.col("title"))), "source", "doc_id").select("source", "doc_id", "title", "total_items", "included_in_prompt", "omitted_from_prompt")


def title_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_items(spark, sf_dir)
    n = F.col("page_id") % 5
    none = F.lit(None).cast("string")
    title = F.when(n == 0, F.col("title"))
    fetched = F.when(n == 1, F.lit("  Fetched\n title "))
    made = F.when(n == 2, F.lit("made of the text"))
    url = F.when(n < 4, F.col("url"))
    return p.select("page_id", text.resolved_title(title, fetched, made, url, none, F.when(F.col("page_id") % 2 == 0, F.lit("body text"))).alias("title"))


def connector_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of connectors after a poll in which some fail, some succeed, some do both and some aren't polled."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("connector_id"), "s_suppkey")
    n = F.col("s_suppkey") % 4
    old = s.where("s_suppkey % 5 <> 0").select("connector_id", F.lit("9").alias("cursor"), F.lit("t0").alias("last_poll_at"), F.lit("t0").alias("last_success_at"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("old")).alias("last_error"))
    good = s.where(n.isin(1, 3)).select("connector_id", F.when(F.col("s_suppkey") % 3 == 0, F.lit("10")).alias("cursor"), F.lit(True).alias("succeeded"), F.lit(None).cast("string").alias("error"))
    bad = s.where(n.isin(2, 3)).select("connector_id", F.lit(None).cast("string").alias("cursor"), F.lit(False).alias("succeeded"), F.lit("boom").alias("error"))
    return state.health(old, good.unionByName(bad), "t1")


def source_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notice over the errors of each nation's sources, by id."""
    s = table(spark, sf_dir, "supplier")
    errors = s.select("s_nationkey", F.concat(F.lit("s"), "s_suppkey").alias("source"), F.when(F.col("s_acctbal") < 0, F.lit("in debt")).otherwise(F.lit("timeout")).alias("error"))
    return notice(errors, "s_nationkey")


def timestamp_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_rows(spark, sf_dir)
    given = F.when(F.col("k") % 3 == 0, F.concat(F.col("sec").cast("string"), F.lit(".25"))).when(F.col("k") % 3 == 1, times.iso(F.col("sec"))).otherwise(F.lit(""))
    return e.select("event_id", exports.timestamp_text(given).alias("at"))


QUERIES = {
    f.__name__: f
    for f in (conversation_export, response_export, array_elements, typed_payloads, ledger_scan, visit_import, signal_posts, registry_only, registry_metadata, search_routes, prefix_links, prompt_compact, title_ladder, connector_health, source_notices, timestamp_texts)
}
_FLAT = r"trim(regexp_replace({}, '[\s\v\pZ\x1c-\x1f\x85]+', ' ', 'g'))"
_EDGE = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
ORACLES = {
    "conversation_export": f"""
WITH r AS (SELECT conv_id, lower(role) AS role, {_EDGE.format("coalesce(text, '')")} AS t, CASE turn % 3 WHEN 0 THEN turn::DOUBLE WHEN 1 THEN turn + 0.5 ELSE 'infinity'::DOUBLE END AS tm, turn FROM conversations),
l AS (SELECT conv_id, string_agg(role || ': ' || t, chr(10) || chr(10) ORDER BY tm, turn, role) AS body, count(*)::INTEGER AS n FROM r WHERE t <> '' AND coalesce(role, '') <> '' GROUP BY conv_id)
SELECT 'c' || conv_id AS id, sha256(body) AS digest, coalesce(n, 0)::INTEGER AS message_count, '2023-11-14T22:13:20Z' AS created_at FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN l USING (conv_id)""",
    "response_export": f"""
WITH r AS (SELECT conv_id, turn, lower(role) AS role, {_EDGE.format("CASE WHEN turn % 4 = 3 THEN '' ELSE coalesce(text, '') END")} AS t FROM conversations WHERE conv_id % 3 <> 2),
b AS (SELECT conv_id, string_agg(coalesce(nullif(role, ''), 'unknown') || ': ' || t, chr(10) || chr(10) ORDER BY turn, role, t) FILTER (t <> '') AS body, count(*)::INTEGER AS n FROM r GROUP BY conv_id)
SELECT 'r' || conv_id AS id, sha256(body) AS digest, coalesce(n, 0)::INTEGER AS response_count FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN b USING (conv_id)""",
    "array_elements": f"""
SELECT coalesce(source, 'none') AS source, row_number() OVER (PARTITION BY coalesce(source, 'none') ORDER BY doc_id) - 1 AS place, doc_id, sha256(coalesce(text, '') || '{_AWKWARD}') AS digest FROM documents""",
    "typed_payloads": "WITH "
    + ITEMS_SQL
    + """ SELECT id, source, 1 AS people, 0 AS topics, CASE WHEN doc_id % 2 = 0 THEN saved END AS saved, CASE WHEN doc_id % 2 = 0 THEN false END AS unread
FROM items WHERE doc_id % 13 <> 0 AND doc_id % 11 <> 0 AND source IS NOT NULL""",
    "ledger_scan": "WITH " + EVENTS_SQL + f" SELECT 'e' || event_id AS id, event_type AS source, {ISO_SQL.format('sec')} AS retrieved_at, true AS whole FROM ev WHERE k % 10 > 1 AND k % 7 <> 0 AND sec >= 1704844800 AND sec < 1705017600",
    "visit_import": "WITH "
    + EVENTS_SQL
    + f""", v AS (
  SELECT 'u' || user_id AS conversation_id, 'https://grok.com/c/u' || user_id AS canonical_url, sec, event_id, k % 6 AS n,
    'https://grok.com/c/u' || user_id || CASE k % 4 WHEN 1 THEN '?rid=r' || (k % 3) ELSE '' END AS variant,
    CASE k % 5 WHEN 0 THEN 'Grok' WHEN 1 THEN NULL ELSE 'T' || event_id END AS title FROM ev WHERE k % 4 <> 3
) SELECT conversation_id, canonical_url, string_agg(DISTINCT variant, ' ' ORDER BY variant) AS variants, sum(n)::BIGINT AS visit_count, {ISO_SQL.format('max(sec)')} AS modified_at,
  arg_min(title, (title = 'Grok', -sec, -event_id)) FILTER (title IS NOT NULL) AS title FROM v GROUP BY ALL""",
    "signal_posts": "WITH "
    + EVENTS_SQL
    + """, r AS (SELECT event_type, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1)::INTEGER AS pos FROM ev WHERE event_type IN ('click', 'view'))
SELECT CASE event_type WHEN 'click' THEN 'x_bookmarks' ELSE 'x_likes' END AS source, pos, event_id::VARCHAR AS id, CASE WHEN event_id % 5 < 3 THEN 'user' || (event_id % 5) END AS username FROM r WHERE pos < 100""",
    "registry_only": """
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ' v2' ELSE s_name END AS title, (-s_suppkey)::INTEGER AS place
FROM supplier SEMI JOIN (SELECT c_custkey AS s_suppkey FROM customer WHERE c_custkey % 3 = 0) USING (s_suppkey)""",
    "registry_metadata": """
SELECT s_suppkey, '{' || concat_ws(',', CASE WHEN s_suppkey % 2 = 0 THEN '"category_hint":"ai"' END, CASE WHEN s_suppkey % 5 = 0 THEN '"topical_scopes":"car,it"' END) || '}' AS metadata FROM supplier""",
    "search_routes": """
WITH s AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT 's' || k AS source, 'direct' AS route, 1 AS rank, 'A ' || k AS title, 'https://www.example.com/a-' || k AS url FROM s WHERE k % 3 <> 0 AND k % 4 <> 0
UNION ALL SELECT 's' || k, 'direct', 3, 'B c', 'https://example.com/b_c' FROM s WHERE k % 3 <> 0 AND k % 4 <> 0
UNION ALL SELECT 's' || k, 'search', 1, 'R', 'https://example.com/r' || k FROM s WHERE k % 3 = 0""",
    "prefix_links": "SELECT page_id % 10 AS map, (row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id))::INTEGER AS place, url FROM pages WHERE url LIKE 'https://%'",
    "prompt_compact": "WITH "
    + ITEMS_SQL
    + rf""", o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY source) AS total,
  {_FLAT.format("CASE WHEN doc_id % 3 <> 0 THEN title END")} AS own, {_FLAT.format('body')} AS b FROM items)
SELECT source, doc_id, CASE WHEN coalesce(own, '') <> '' THEN own WHEN doc_id % 2 = 0 THEN 'd.example/' || doc_id WHEN b = '' THEN 'Untitled item' WHEN length(b) > 160 THEN substr(b, 1, 159) || '…' ELSE b END AS title,
  total AS total_items, least(total, 50) AS included_in_prompt, greatest(total - 50, 0) AS omitted_from_prompt FROM o WHERE n <= 50""",
    "title_ladder": PAGES_SQL
    + rf""", t AS (SELECT page_id, regexp_replace(url, '^.*?//', '') AS bare, {_FLAT.format('title')} AS t FROM pg)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN CASE WHEN coalesce(t, '') = '' THEN bare WHEN length(t) > 160 THEN substr(t, 1, 159) || '…' ELSE t END WHEN 1 THEN 'Fetched title' WHEN 2 THEN 'made of the text' WHEN 3 THEN bare
  ELSE CASE WHEN page_id % 2 = 0 THEN 'body text' ELSE 'Untitled item' END END AS title FROM t""",
    "connector_health": """
WITH s AS (SELECT s_suppkey AS k, s_suppkey % 4 IN (1, 3) AS good, s_suppkey % 4 <> 0 AS polled, s_suppkey % 5 <> 0 AS had FROM supplier)
SELECT 's' || k AS connector_id, CASE WHEN good AND k % 3 = 0 THEN '10' WHEN had THEN '9' END AS cursor, CASE WHEN polled THEN 't1' ELSE 't0' END AS last_poll_at,
  CASE WHEN good THEN 't1' WHEN had THEN 't0' END AS last_success_at, CASE WHEN good THEN NULL WHEN polled THEN 'boom' WHEN k % 2 = 0 THEN 'old' END AS last_error FROM s WHERE had OR polled""",
    "source_notices": """
SELECT s_nationkey, count(*)::INTEGER AS n, string_agg('s' || s_suppkey || ': ' || CASE WHEN s_acctbal < 0 THEN 'in debt' ELSE 'timeout' END, chr(10) ORDER BY 's' || s_suppkey) AS notice FROM supplier GROUP BY 1""",
    "timestamp_texts": "WITH " + EVENTS_SQL + f" SELECT event_id, CASE WHEN k % 3 < 2 THEN {ISO_SQL.format('sec')} END AS at FROM ev",
}

"""Text, page, classification, clustering and source queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybreak.functions import category, text, times, urls
from daybreak.operators import cluster
from daybreak.operators.bindings import EVENTS_SQL, ITEMS_SQL, document_items, event_rows, page_items
from daybreak.operators.dedupe import first_wins
from daybreak.plans.ledger import ISO_SQL, PAGES_SQL
from daybreak.session import ship, table
from daybreak.sources import items as sources
from daybreak.sources.html import article_text_udf, page_links_udf


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_items(spark, sf_dir).select("page_id", F.coalesce("title", "url").alias("title"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_items(spark, sf_dir).select("page_id", F.length("body").alias("n"), F.sha2("body", 256).alias("digest"))


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_items(spark, sf_dir)
    return pages.groupBy("source").agg(F.count("*").alias("n"), F.count_if(urls.on_domain(F.col("url"), F.lit("example.com"))).alias("on_domain"))


def page_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.slug_title(F.col("url")).alias("title"))


def article_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "pages").select("page_id", article_text_udf("html").alias("body"))


def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.posexplode(page_links_udf("html", "url")).alias("pos", "url"))


def page_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the title and the text of the page of the same number, where there is one."""
    pages = page_items(spark, sf_dir).select(F.col("page_id").alias("doc_id"), F.col("title").alias("page_title"), F.col("body").alias("page_body"))
    joined = document_items(spark, sf_dir).join(pages, "doc_id", "left")
    return joined.select("id", F.coalesce("page_title", "title").alias("title"), F.length(F.coalesce("page_body", "body")).alias("n"), F.col("page_title").isNotNull().alias("enriched"))


def domain_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of example.com by language part: the gapped rank before the domain filter and the dense one after it."""
    pages = table(spark, sf_dir, "pages").withColumn("part", F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)/", 1))
    w = Window.partitionBy("part").orderBy("page_id")
    on = pages.withColumn("gapped", F.row_number().over(w)).where(urls.on_domain(F.col("url"), F.lit("example.com")))
    return on.select("page_id", "part", "gapped", F.row_number().over(w).alias("dense"))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    hints = F.array(F.lower("n_name"), F.when(F.col("s_suppkey") % 4 == 0, F.lit(" site:own.example.org ")).otherwise(F.lit(" ")))
    return s.select("s_suppkey", urls.search_query(hints, F.concat(F.lit("s"), "s_suppkey", F.lit(".example.com"))).alias("query"))


def redirect_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    wrapped = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("//search.example.com/l/?uddg="), F.url_encode("url"), F.lit("&rut=1"))).otherwise(F.col("url"))
    return pages.select("page_id", urls.unwrapped(wrapped, "search.example.com", "uddg").alias("url"))


def category_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_items(spark, sf_dir).select("id", category.classify(_haystack()).alias("category"))


def _haystack() -> Column:
    return category.haystack(*map(F.col, ("source", "kind", "title", "body")))


def category_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories with a hint from the source's number, in the fixed order."""
    items = document_items(spark, sf_dir)
    number = F.substring("source", 4, 5).cast("int")
    hint = F.when(number == 1, "EV").when(number == 2, "developer_tools").when(number == 3, "Photo")
    start = F.when(number == 4, F.lit("2024-01-01T00:00:00Z"))
    explicit = F.when(number == 5, "Tech")
    named = items.select(category.classify(_haystack(), explicit=(F.lit(None).cast("string"), explicit), hint=(hint,), scheduled=category.has_schedule(start, F.lit(""))).alias("category"), "id")
    place = F.array_position(F.array(*map(F.lit, category.ORDER)), F.col("category")).cast("int")
    return named.groupBy("category").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).withColumn("place", place)


def signature_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = document_items(spark, sf_dir)
    return items.select("id", F.array_join(cluster.signature(F.col("title"), F.col("body")), " ").alias("tokens"))


def text_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_items(spark, sf_dir).select("id", cluster.text_weight(F.col("title"), F.col("body")).cast("long").alias("weight"), cluster.token_estimate(F.col("title"), F.col("body")).alias("tokens"))


def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = document_items(spark, sf_dir).withColumn("tokens", cluster.token_estimate(F.col("title"), F.col("body")))
    return cluster.balanced_chunks(items, "source", "doc_id", "tokens", 10)


def greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    items = document_items(spark, sf_dir).withColumn("tokens", cluster.signature(F.col("title"), F.col("body")))
    return cluster.greedy_clusters(items, "source", "doc_id", "tokens")


def message_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return cluster.split_messages(table(spark, sf_dir, "documents"), "doc_id", "text")


def kv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_rows(spark, sf_dir)
    note = F.concat(F.lit("Item: "), "event_type", F.lit("\nno pair here\n COUNT : "), F.col("k").cast("string"), F.lit("\ncount: "), (F.col("k") + 1).cast("string"))
    values = text.key_values(note)
    return e.select("event_id", F.try_element_at(values, F.lit("item")).alias("item"), F.try_element_at(values, F.lit("count")).alias("n"))


def truncates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text")).alias("short"))


def calendar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calendar events of an hour; the priority's digit gives tens of travel minutes."""
    o = table(spark, sf_dir, "orders").withColumn("sec", times.seconds("o_orderdate"))
    events = o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("summary"), times.iso(F.col("sec")).alias("start"), times.iso(F.col("sec") + 3600).alias("end"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("Room")).alias("location"), F.array(F.concat(F.lit('{"email":"c'), "o_custkey", F.lit('@example.com"}')), F.lit("Guest")).alias("attendees"), (10 * F.substring("o_orderpriority", 1, 1).cast("int")).alias("travel_minutes"))
    return sources.calendar_items(events).select("id", "title", "start", "end", F.array_join("people", ",").alias("people"), F.size("place_refs").alias("places"), "travel_minutes")


def mail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_rows(spark, sf_dir)
    labels = F.when(F.col("k") % 4 == 0, F.array(F.lit("INBOX"), F.lit("UNREAD"))).when(F.col("k") % 4 == 1, F.array(F.lit("INBOX")))
    messages = e.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("threadId"), F.concat(F.lit("u"), "user_id").alias("from"), F.when(F.col("k") % 3 == 0, F.lit("")).otherwise(F.lit("me")).alias("to"), F.col("event_type").alias("subject"), F.when(F.col("k") % 5 == 0, F.lit("")).otherwise(F.lit("body")).alias("body"), F.concat(F.lit("snippet "), F.col("k").cast("string")).alias("snippet"), labels.alias("labels"))
    return sources.mail_items(messages).select("id", "title", "body", F.array_join("people", ",").alias("people"), "unread", "open_loop")


def first_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first unread mail of each user."""
    e = event_rows(spark, sf_dir).where("k % 4 = 0")
    return first_wins(e, ["user_id"], "event_id").select("user_id", "event_id")


def note_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("/notes/n"), "doc_id", F.lit(".md")).alias("path"), F.concat(F.lit("## "), "text").alias("value"))
    return sources.note_items(files).select("id", "title", F.length("body").alias("n"))


def conversation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.conversation_items(table(spark, sf_dir, "conversations"))


def message_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by (time or last, position): every third turn has no time."""
    c = table(spark, sf_dir, "conversations")
    when = F.when(F.col("turn") % 3 != 2, 1000 - F.col("turn"))
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last(when), "turn")
    return c.select("conv_id", "turn", F.row_number().over(w).alias("place"))


def session_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    first = c.groupBy("conv_id").agg(F.min_by("text", F.struct("turn", "role")).alias("text"), F.max("turn").alias("last"))
    return first.select(F.concat(F.lit("session:"), "conv_id").alias("id"), F.substring(text.collapse(text.first_line(F.col("text"))), 1, 80).alias("title"), "last")


def history_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of conversations left-joined to their responses; all responses count, blank ones give no line."""
    c = table(spark, sf_dir, "conversations")
    index = c.select("conv_id").distinct()
    responses = c.withColumn("message", F.when(F.col("turn") % 3 == 1, F.lit(" ")).otherwise(F.col("text")))
    body = sources.conversation_items(responses.select("conv_id", "turn", "role", F.col("message").alias("text"))).select("conv_id", "body")
    counts = responses.groupBy("conv_id").agg(F.count("*").alias("response_count"))
    out = index.join(body, "conv_id", "left").join(counts, "conv_id", "left")
    return out.select("conv_id", F.sha2("body", 256).alias("digest"), F.coalesce("response_count", F.lit(0)).alias("response_count"))


def history_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("modified"))
    w = Window.partitionBy(F.col("conv_id") % 4).orderBy(F.desc("modified"), F.desc("conv_id"))
    return c.select("conv_id", F.row_number().over(w).alias("place"))


def post_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_rows(spark, sf_dir)
    posts = e.select(F.col("event_id").cast("string").alias("id"), F.when(F.col("k") % 9 != 0, F.col("event_type")).otherwise(F.lit("  ")).alias("text"), F.col("user_id").alias("author_id"), F.array(F.lit("ftp://x"), F.concat(F.lit("https://t.example/"), F.col("k").cast("string"))).alias("urls"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.regexp_replace("c_name", "[# ]", "_").alias("username"))
    return sources.post_items(posts, users, "bookmarks")


def snapshot_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot's distinct posts by (user, k): the first of each, with an id, at most 50 a type."""
    e = event_rows(spark, sf_dir).where("k > 0")
    once = first_wins(e, ["event_type", "user_id", "k"], "event_id")
    place = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    return once.withColumn("place", place).where("place <= 50").select("event_type", "place", "event_id")


def visit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of pages by host: their sum, last time, distinct addresses and first usable title."""
    pages = F.lit(max(1, table(spark, sf_dir, "pages").count()))
    e = event_rows(spark, sf_dir).groupBy((F.col("event_id") % pages).alias("page_id")).agg(F.count("*").alias("visits"), F.max("sec").alias("last"))
    p = page_items(spark, sf_dir).join(e, "page_id")
    generic = F.length(F.coalesce("title", F.lit(""))) < 30
    return p.groupBy("source").agg(F.sum("visits").alias("visits"), F.max("last").alias("last"), F.array_join(F.sort_array(F.collect_set("url")), " ").alias("urls"), F.min_by("title", F.struct(generic, F.col("page_id"))).alias("title"))


def preset_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connectors in the order of a preset: documents, pages, conversations."""
    docs = document_items(spark, sf_dir).select("id", F.lit(1).alias("preset_pos"))
    pages = page_items(spark, sf_dir).select("id", F.lit(2).alias("preset_pos"))
    conversations = table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv:"), "conv_id").alias("id"), F.lit(3).alias("preset_pos")).distinct()
    return docs.unionByName(pages).unionByName(conversations)


def registry_payload_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("src"), F.col("s_suppkey") % 40).alias("source"), "s_suppkey")
    registry = first_wins(s, ["source"], "s_suppkey")
    return document_items(spark, sf_dir).join(registry, "source").select("id", "source", F.col("s_suppkey").alias("registry_id"))


def link_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's rendered links hold one of the expected addresses; without any expected it passes."""
    p = table(spark, sf_dir, "pages")
    markdown = F.concat(F.lit("see [one]("), "url", F.lit(") and [two](https://b.example/"), F.col("page_id") % 5, F.lit(")"))
    expected = F.when(F.col("page_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("page_id") % 3 == 1, F.array("url")).otherwise(F.array(F.lit("https://b.example/1")))
    found = text.link_urls(markdown)
    return p.select("page_id", ((F.size(expected) == 0) | F.arrays_overlap(expected, found)).alias("passes"), F.size(found).alias("n"), text.links_to_pipes(markdown).alias("piped"))


def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a document shares with the next one of the same source."""
    items = document_items(spark, sf_dir).withColumn("tokens", cluster.signature(F.col("title"), F.col("body")))
    nxt = F.lead("tokens").over(Window.partitionBy("source").orderBy("doc_id"))
    return items.select("id", F.coalesce(F.size(F.array_intersect("tokens", nxt)), F.lit(0)).alias("shared"))


def link_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each http address without its query, its title shortened."""
    p = page_items(spark, sf_dir).where(F.col("url").startswith("http")).withColumn("address", F.regexp_replace("url", r"[?#].*$", ""))
    return first_wins(p, ["address"], "page_id").select("address", text.truncate(F.coalesce("title", "url"), 40).alias("title"))


def message_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_rows(spark, sf_dir)
    message = F.when(F.col("k") % 3 == 0, F.concat(F.lit("Spend Cap reached until 2024-0"), F.col("k") % 9 + 1, F.lit("-15."))).when(F.col("k") % 3 == 1, "CreditsDepleted").otherwise("timeout")
    return e.select("event_id", text.spend_cap(message).alias("capped"), text.reset_date(message).alias("reset_date"))


def time_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_rows(spark, sf_dir)
    chrome = F.col("sec") * 1000000 + 11644473600000000
    mixed = F.when(F.col("k") % 2 == 0, F.col("sec").cast("string")).otherwise(times.iso(F.col("sec")))
    return e.select("event_id", times.iso(F.col("sec")).alias("iso"), times.browser_seconds(chrome).alias("browser"), times.sort_seconds(mixed).alias("sort_key"))


def json_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes merged with an error: objects keep their keys, other text becomes a review note."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("props")).otherwise(F.concat(F.lit("note "), F.col("event_id"))).alias("notes"))
    parsed = F.try_parse_json("notes")
    k = F.try_variant_get(parsed, "$.k", "int")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return e.select("event_id", k.alias("k"), F.when(~is_object, F.col("notes")).alias("review_note"), F.to_json(F.struct(F.when(k > 50, F.lit("late")).alias("last_error"))).alias("details"))


def account_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account of each conversation's manifest, else its user's email: a system turn stands for the one, a user turn for the other."""
    c = table(spark, sf_dir, "conversations")
    manifest = c.where("lower(role) = 'system'").groupBy("conv_id").agg(F.min(F.concat(F.lit("acct"), "conv_id")).alias("account"))
    user = c.where("lower(role) = 'user'").groupBy("conv_id").agg(F.min(F.concat(F.lit("u"), "conv_id", F.lit("@example.com"))).alias("email"))
    return c.select("conv_id").distinct().join(manifest, "conv_id", "left").join(user, "conv_id", "left").select("conv_id", F.coalesce("account", "email").alias("account"))


QUERIES = {
    f.__name__: f
    for f in (page_titles, page_text, page_hosts, page_slugs, article_bodies, link_extract, page_enrich, domain_ranks, search_queries, redirect_unwrap, category_classify, category_groups, signature_tokens, text_weights, token_chunks, greedy_clusters, message_split, kv_parse, truncates, calendar_rows, mail_rows, first_unread, note_rows, conversation_rollup, message_order, session_items, history_import, history_order, post_rows, snapshot_posts, visit_rollup, preset_union, registry_payload_join, link_check, set_overlap, link_context, message_class, time_kernels, json_kernels, account_lookup)
}

_FLAT = r"trim(regexp_replace({}, '[\s\v\pZ\x1c-\x1f\x85]+', ' ', 'g'))"
_SHORT = "CASE WHEN length({0}) > {1} THEN substr({0}, 1, {1} - 1) || '…' ELSE {0} END"
_DOMAIN = r"(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) = 'example.com' OR lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) LIKE '%.example.com')"


_HAYSTACK = "concat_ws(' ', source, kind, title, body)"


def _keyword_sql(column: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower({column}), '({'|'.join(w.replace('.', chr(92) + '.') for w in words)})') THEN '{name}'" for name, words in category.KEYWORDS.items())
    return f"CASE {cases} ELSE 'it' END"


_SIG = "list_sort(list_distinct(list_filter(regexp_extract_all(lower(concat_ws(' ', title, body)), '[a-z0-9]{3,}'), lambda t: NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN (" + ", ".join(f"'{w}'" for w in cluster.STOPWORDS) + "))))"
SIG_SQL = "WITH " + ITEMS_SQL + f", sg AS (SELECT id, doc_id, source, {_SIG} AS tokens FROM items)"

ORACLES = {
    "page_titles": PAGES_SQL + " SELECT page_id, coalesce(title, url) AS title FROM pg",
    "page_text": PAGES_SQL + " SELECT page_id, length(body)::INTEGER AS n, sha256(body) AS digest FROM pg",
    "page_hosts": PAGES_SQL + f" SELECT source, count(*) AS n, count_if({_DOMAIN})::BIGINT AS on_domain FROM pg GROUP BY source",
    "page_slugs": r"""
WITH s AS (SELECT page_id, url, trim(translate(list_last(string_split(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '^[a-zA-Z]+://[^/]*', ''), '/')), '-_', '  ')) AS w FROM pages)
SELECT page_id, CASE WHEN w = '' THEN url ELSE upper(substr(w, 1, 1)) || substr(w, 2) END AS title FROM s""",
    "page_enrich": PAGES_SQL + ", " + ITEMS_SQL + " SELECT i.id, coalesce(pg.title, i.title) AS title, length(coalesce(pg.body, i.body))::INTEGER AS n, pg.title IS NOT NULL AS enriched FROM items i LEFT JOIN pg ON pg.page_id = i.doc_id",
    "domain_ranks": rf"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS part FROM pages),
g AS (SELECT *, (row_number() OVER (PARTITION BY part ORDER BY page_id))::INTEGER AS gapped FROM p)
SELECT page_id, part, gapped, (row_number() OVER (PARTITION BY part ORDER BY page_id))::INTEGER AS dense FROM g WHERE {_DOMAIN}""",
    "search_queries": """
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN lower(n_name) || ' site:own.example.org' ELSE 'site:s' || s_suppkey || '.example.com ' || lower(n_name) END AS query
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "redirect_unwrap": "SELECT page_id, url FROM pages",
    "category_classify": "WITH " + ITEMS_SQL + f" SELECT id, {_keyword_sql(_HAYSTACK)} AS category FROM items",
    "category_groups": "WITH "
    + ITEMS_SQL
    + f""", n AS (SELECT id, CASE source WHEN 'src1' THEN 'car' WHEN 'src2' THEN 'it' WHEN 'src3' THEN 'camera' WHEN 'src4' THEN 'schedule' WHEN 'src5' THEN 'it' ELSE {_keyword_sql(_HAYSTACK)} END AS category FROM items)
SELECT category, count(*) AS n, min(id) AS first_id, list_position(['ai', 'it', 'finance', 'camera', 'car', 'schedule'], category)::INTEGER AS place FROM n GROUP BY category""",
    "signature_tokens": SIG_SQL + " SELECT id, array_to_string(tokens, ' ') AS tokens FROM sg",
    "set_overlap": SIG_SQL + ", l AS (SELECT id, tokens, lead(tokens) OVER (PARTITION BY source ORDER BY doc_id) AS n FROM sg) SELECT id, coalesce(len(list_intersect(tokens, n)), 0)::INTEGER AS shared FROM l",
    "text_weights": "WITH " + ITEMS_SQL + " SELECT id, (length(title) + length(body))::BIGINT AS weight, greatest(1, length(concat_ws(' ', nullif(title, ''), nullif(body, ''))) // 24)::INTEGER AS tokens FROM items",
    "token_chunks": "WITH RECURSIVE "
    + ITEMS_SQL
    + """, t AS (SELECT source, doc_id, greatest(1, length(concat_ws(' ', nullif(title, ''), nullif(body, ''))) // 24)::BIGINT AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM items),
g AS (SELECT source, ceil(count(*) / 10)::INTEGER AS n, sum(tokens)::BIGINT AS total, count(*) AS size FROM t GROUP BY source),
f AS (
  SELECT source, 0::BIGINT AS i, 1 AS chunk, 0::BIGINT AS held, 0 AS used FROM g
  UNION ALL
  SELECT t.source, t.i, CASE WHEN c THEN chunk + 1 ELSE chunk END, CASE WHEN c THEN 0 ELSE held + t.tokens END, chunk
  FROM (SELECT f.source, f.chunk, f.held, t.i, t.tokens, f.chunk < g.n AND f.held + t.tokens >= g.total / g.n AND g.size - t.i >= g.n - f.chunk AS c
    FROM f JOIN t ON t.source = f.source AND t.i = f.i + 1 JOIN g ON g.source = f.source) t
) SELECT t.source, t.doc_id, f.used::INTEGER AS chunk FROM f JOIN t USING (source, i)""",
    "kv_parse": "WITH " + EVENTS_SQL + " SELECT event_id, event_type AS item, (k + 1)::VARCHAR AS n FROM ev",
    "truncates": f"WITH f AS (SELECT doc_id, {_FLAT.format('text')} AS t FROM documents) SELECT doc_id, {_SHORT.format('t', 160)} AS short FROM f",
    "calendar_rows": f"""
SELECT 'calendar:' || o_orderkey AS id, o_orderpriority AS title, {ISO_SQL.format('(epoch_us(o_orderdate) // 1000000)')} AS start, {ISO_SQL.format('(epoch_us(o_orderdate) // 1000000 + 3600)')} AS "end",
  'c' || o_custkey || '@example.com,Guest' AS people, (o_orderkey % 2 = 0)::INTEGER AS places, 10 * substr(o_orderpriority, 1, 1)::INTEGER AS travel_minutes FROM orders""",
    "mail_rows": "WITH "
    + EVENTS_SQL
    + """ SELECT 'gmail:' || event_id AS id, event_type AS title, CASE WHEN k % 5 = 0 THEN 'snippet ' || k ELSE 'body' END AS body,
  CASE WHEN k % 3 = 0 THEN 'u' || user_id ELSE 'u' || user_id || ',me' END AS people, k % 4 = 0 AS unread, k % 4 = 0 AS open_loop FROM ev""",
    "first_unread": "WITH " + EVENTS_SQL + " SELECT user_id, min(event_id) AS event_id FROM ev WHERE k % 4 = 0 GROUP BY user_id",
    "note_rows": "SELECT 'note:n' || doc_id AS id, trim(regexp_replace(split_part('## ' || text, chr(10), 1), '^[# ]+', '')) AS title, (length(text) + 3)::INTEGER AS n FROM documents",
    "conversation_rollup": "SELECT conv_id, string_agg(lower(role) || ': ' || trim(text), chr(10) || chr(10) ORDER BY turn) AS body, count(*) AS message_count FROM conversations WHERE trim(text) <> '' AND trim(role) <> '' GROUP BY conv_id",
    "message_order": "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 3 <> 2 THEN 1000 - turn END ASC NULLS LAST, turn))::INTEGER AS place FROM conversations",
    "session_items": f"""
WITH f AS (SELECT conv_id, arg_min(text, (turn, role)) AS text, max(turn) AS last FROM conversations GROUP BY conv_id)
SELECT 'session:' || conv_id AS id, left({_FLAT.format("split_part(text, chr(10), 1)")}, 80) AS title, last FROM f""",
    "history_import": """
WITH r AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 1 THEN ' ' ELSE text END AS t FROM conversations),
b AS (SELECT conv_id, string_agg(lower(role) || ': ' || trim(t), chr(10) || chr(10) ORDER BY turn) AS body FROM r WHERE trim(t) <> '' GROUP BY conv_id),
n AS (SELECT conv_id, count(*) AS n FROM r GROUP BY conv_id)
SELECT c.conv_id, sha256(b.body) AS digest, coalesce(n.n, 0) AS response_count FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b USING (conv_id) LEFT JOIN n USING (conv_id)""",
    "history_order": "WITH c AS (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY 1) SELECT conv_id, (row_number() OVER (PARTITION BY conv_id % 4 ORDER BY m DESC, conv_id DESC))::INTEGER AS place FROM c",
    "post_rows": "WITH "
    + EVENTS_SQL
    + """ SELECT event_id::VARCHAR AS id, CASE WHEN k % 9 <> 0 THEN event_type ELSE 'Untitled post' END AS title,
  'https://x.com/' || coalesce(regexp_replace(c_name, '[# ]', '_', 'g'), 'i/web') || '/status/' || event_id AS url, 'https://t.example/' || k AS target_url, true AS saved, false AS liked
FROM ev LEFT JOIN customer ON c_custkey = user_id""",
    "snapshot_posts": "WITH "
    + EVENTS_SQL
    + """, o AS (SELECT * FROM ev WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY event_type, user_id, k ORDER BY event_id) = 1)
SELECT event_type, (row_number() OVER (PARTITION BY event_type ORDER BY event_id))::INTEGER AS place, event_id FROM o QUALIFY place <= 50""",
    "visit_rollup": PAGES_SQL
    + ", "
    + EVENTS_SQL
    + """, v AS (SELECT event_id % (SELECT greatest(1, count(*)) FROM pages) AS page_id, count(*) AS visits, max(sec) AS last FROM ev GROUP BY 1)
SELECT source, sum(visits)::BIGINT AS visits, max(last) AS last, string_agg(DISTINCT url, ' ' ORDER BY url) AS urls, arg_min(title, (length(coalesce(title, '')) < 30, page_id)) AS title FROM pg JOIN v USING (page_id) GROUP BY source""",
    "preset_union": "SELECT 'doc:' || doc_id AS id, 1 AS preset_pos FROM documents UNION ALL SELECT 'page:' || page_id, 2 FROM pages UNION ALL SELECT DISTINCT 'conv:' || conv_id, 3 FROM conversations",
    "registry_payload_join": "WITH r AS (SELECT 'src' || (s_suppkey % 40) AS source, min(s_suppkey) AS k FROM supplier GROUP BY 1) SELECT 'doc:' || doc_id AS id, source, k AS registry_id FROM documents JOIN r USING (source)",
    "link_check": """
SELECT page_id, page_id % 3 IN (0, 1) OR page_id % 5 = 1 AS passes, 2 AS n, 'see <' || url || '|one> and <https://b.example/' || (page_id % 5) || '|two>' AS piped FROM pages""",
    "link_context": PAGES_SQL
    + rf""", f AS (SELECT regexp_replace(url, '[?#].*$', '') AS address, {_FLAT.format("coalesce(title, url)")} AS t, page_id FROM pg WHERE url LIKE 'http%')
SELECT address, {_SHORT.format('t', 40)} AS title FROM f QUALIFY row_number() OVER (PARTITION BY address ORDER BY page_id) = 1""",
    "message_class": "WITH " + EVENTS_SQL + " SELECT event_id, k % 3 <> 2 AS capped, CASE WHEN k % 3 = 0 THEN '2024-0' || (k % 9 + 1) || '-15' END AS reset_date FROM ev",
    "time_kernels": "WITH " + EVENTS_SQL + f" SELECT event_id, {ISO_SQL.format('sec')} AS iso, sec AS browser, sec::DOUBLE AS sort_key FROM ev",
    "json_kernels": """
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k, CASE WHEN event_id % 3 = 0 THEN 'note ' || event_id END AS note FROM events)
SELECT event_id, k, note AS review_note, CASE WHEN k > 50 THEN '{"last_error":"late"}' ELSE '{}' END AS details FROM e""",
    "account_lookup": "SELECT conv_id, CASE WHEN bool_or(lower(role) = 'system') THEN 'acct' || conv_id WHEN bool_or(lower(role) = 'user') THEN 'u' || conv_id || '@example.com' END AS account FROM conversations GROUP BY conv_id",
}

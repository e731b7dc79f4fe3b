"""Source transforms: raw frames to item frames. Fetching is the caller's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybreak.functions.text import slug_title
from daybreak.functions.urls import on_domain, unwrapped
from daybreak.sources.html import article_text_udf, feed_entries_udf, search_results_udf, sitemap_udf

MOST_PER_SOURCE = 20


def feed_items(registry: DataFrame, payloads: DataFrame, most: int = MOST_PER_SOURCE) -> DataFrame:
    """(source, rank, item_id, title, url, ...) of every feed; a payload that can't be parsed gives no rows."""
    joined = registry.join(payloads, "source").withColumn("entries", feed_entries_udf("payload"))
    rows = joined.select("source", "domain", F.posexplode("entries").alias("pos", "e")).where(F.col("pos") < most)
    return rows.select("source", (F.col("pos") + 1).alias("rank"), F.concat_ws(":", "source", "e.guid").alias("item_id"), F.coalesce("e.title", "e.url").alias("title"), "e.url", "e.created_at", "e.updated_at", "e.excerpt")


def feed_errors(payloads: DataFrame) -> DataFrame:
    """Sources whose payload can't be parsed; the others are unaffected."""
    return payloads.where(feed_entries_udf("payload").isNull()).select("source", F.lit("unparsable feed").alias("error"))


def sitemap_items(registry: DataFrame, payloads: DataFrame, most: int = MOST_PER_SOURCE) -> DataFrame:
    """Locations on the source's domain; ranks count before the filter, so they have gaps."""
    joined = registry.join(payloads, "source").withColumn("map", sitemap_udf("payload")).where("map.kind = 'urlset'")
    rows = joined.select("source", "domain", F.posexplode("map.locations").alias("pos", "url")).where(on_domain(F.col("url"), F.col("domain")))
    place = F.row_number().over(Window.partitionBy("source").orderBy("pos"))
    return rows.withColumn("n", place).where(F.col("n") <= most).select("source", (F.col("pos") + 1).alias("rank"), "url", slug_title(F.col("url")).alias("title"))


def sitemap_prefix(maps: DataFrame, key: str, prefix: str) -> DataFrame:
    """(key, place, url): a sitemap's locations that begin with a prefix, in document order."""
    found = F.filter(sitemap_udf("payload").locations, lambda u: u.startswith(prefix))
    return maps.select(key, F.posexplode(found).alias("pos", "url")).select(key, (F.col("pos") + 1).alias("place"), "url")


def known_source_items(registry: DataFrame, direct: DataFrame, results: DataFrame) -> DataFrame:
    """(source, route, rank, title, url) of sources of mode known_source_search.

    direct: (source, urls) of sources that were read themselves; an empty list is an answer, a missing one means search. results: (source, html).
    """
    wanted = registry.where("acquisition_mode = 'known_source_search'").select("source", "domain")
    own = wanted.join(direct.where("urls is not null"), "source")
    searched = wanted.join(own.select("source"), "source", "left_anti")
    rows = direct_items(own).withColumn("route", F.lit("direct"))
    return rows.unionByName(search_items(searched, results).withColumn("route", F.lit("search")), allowMissingColumns=True).select("source", "route", "rank", "title", "url")


def enriched(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items with the article text of their page, where there is one: (url, html) pages."""
    bodies = pages.select("url", article_text_udf("html").alias("article"))
    return items.join(bodies, "url", "left").withColumn("body", F.coalesce("article", "body")).drop("article")


def sitemap_index(roots: DataFrame, payloads: DataFrame, most: int = MOST_PER_SOURCE, rounds: int | None = None) -> DataFrame:
    """(source, pos, url): locations below sitemap indexes in document order, sharing one budget a source; no map is read twice.

    roots: (source, url); payloads: (url, payload). A round reads the maps of one level, until none is left unread;
    a caller may set a number of rounds.
    """
    open_maps = roots.select("source", "url", F.array(F.lit(0)).alias("path"))
    visited = open_maps.select("source", "url")
    found = []
    while not found or (rounds is None or len(found) < rounds) and not open_maps.isEmpty():
        parsed = open_maps.join(payloads, "url").withColumn("map", sitemap_udf("payload"))
        rows = parsed.select("source", "path", "map.kind", F.posexplode("map.locations").alias("pos", "loc")).withColumn("path", F.concat("path", F.array("pos")))
        found.append(rows.where("kind = 'urlset'").select("source", "path", F.col("loc").alias("url")))
        deeper = rows.where("kind = 'sitemapindex'").groupBy("source", F.col("loc").alias("url")).agg(F.min("path").alias("path"))
        open_maps = deeper.join(visited, ["source", "url"], "left_anti").persist()
        visited = visited.unionByName(open_maps.select("source", "url"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("path"))
    return reduce(DataFrame.unionByName, found).withColumn("pos", place).where(F.col("pos") <= most).select("source", "pos", "url")


def search_items(registry: DataFrame, pages: DataFrame, redirect_host: str = "search.example.com", parameter: str = "uddg") -> DataFrame:
    """Results on the source's domain, with a dense rank after that filter."""
    rows = registry.join(pages, "source").select("source", "domain", F.posexplode(search_results_udf("html")).alias("pos", "r"))
    target = rows.withColumn("url", unwrapped(F.col("r.url"), redirect_host, parameter)).where(on_domain(F.col("url"), F.col("domain")))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("pos"))
    return target.select("source", rank.alias("rank"), F.coalesce("r.title", "url").alias("title"), "url", F.col("r.snippet").alias("excerpt"))


def direct_items(rows: DataFrame) -> DataFrame:
    """(source, domain, urls) lists: gapped ranks, slug titles, only the source's domain."""
    listed = rows.select("source", "domain", F.posexplode("urls").alias("pos", "url"))
    return listed.where(on_domain(F.col("url"), F.col("domain"))).select("source", (F.col("pos") + 1).alias("rank"), "url", slug_title(F.col("url")).alias("title"))


def news_items(rows: DataFrame) -> DataFrame:
    """(source, payload) JSON arrays of objects u, t, n_d, d, c; broken objects and other types are skipped."""
    parsed = rows.select("source", F.posexplode(F.from_json("payload", "array<string>")).alias("pos", "raw"))
    fields = parsed.withColumn("v", F.from_json("raw", "struct<u:string,t:string,n_d:string,d:string,c:array<string>>")).where("v.u is not null and v.u <> ''")
    return fields.select("source", (F.col("pos") + 1).alias("rank"), F.col("v.u").alias("url"), F.coalesce(F.nullif("v.t", F.lit("")), slug_title(F.col("v.u"))).alias("title"), F.coalesce("v.n_d", "v.d").alias("created_at"), F.filter(F.coalesce("v.c", F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("categories"))


def mail_items(messages: DataFrame) -> DataFrame:
    """UNREAD marks a message unread, unresolved and an open loop; the body falls back to the snippet."""
    unread = F.coalesce(F.array_contains("labels", "UNREAD"), F.lit(False))
    people = F.filter(F.array("from", "to"), lambda x: x.isNotNull() & (x != ""))
    return messages.select(F.concat(F.lit("gmail:"), "id").alias("id"), F.col("subject").alias("title"), F.coalesce(F.nullif("body", F.lit("")), F.col("snippet")).alias("body"), people.alias("people"), unread.alias("unread"), unread.alias("unresolved"), unread.alias("open_loop"), "threadId")


def calendar_items(events: DataFrame) -> DataFrame:
    """Attendees are texts or objects with an email or a name; every event is of future relevance."""
    people = F.transform(F.coalesce("attendees", F.array().cast("array<string>")), lambda a: F.coalesce(F.get_json_object(a, "$.email"), F.get_json_object(a, "$.displayName"), a))
    return events.select(F.concat(F.lit("calendar:"), "id").alias("id"), F.col("summary").alias("title"), "start", "end", F.filter(F.array("location"), lambda x: x.isNotNull()).alias("place_refs"), people.alias("people"), F.lit(True).alias("future"), "travel_minutes")


def note_items(files: DataFrame) -> DataFrame:
    """(path, value) whole files: the title is the first line without leading hashes."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    title = F.regexp_replace(F.split_part("value", F.lit("\n"), F.lit(1)), r"^[# ]+", "")
    return files.select(F.concat(F.lit("note:"), stem).alias("id"), F.trim(title).alias("title"), F.col("value").alias("body"))


def conversation_items(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): one item per conversation, its lines `role: text` in order; blank ones don't count."""
    kept = turns.where(F.col("text").isNotNull() & (F.trim("text") != "") & F.col("role").isNotNull() & (F.trim("role") != ""))
    line = F.concat_ws(": ", F.lower("role"), F.trim("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x.line)
    return kept.groupBy("conv_id").agg(F.array_join(lines, "\n\n").alias("body"), F.count("*").alias("message_count"))


def post_items(posts: DataFrame, users: DataFrame, signal: str) -> DataFrame:
    """(id, text, author_id, urls): the author may be missing; the target is the first http address."""
    joined = posts.join(users.withColumnRenamed("id", "author_id"), "author_id", "left")
    link = F.concat(F.lit("https://x.com/"), F.coalesce("username", F.lit("i/web")), F.lit("/status/"), "id")
    target = F.try_element_at(F.filter("urls", lambda u: u.startswith("http")), F.lit(1))
    title = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 80)
    return joined.select("id", F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled post")).alias("title"), link.alias("url"), target.alias("target_url"), F.lit(signal == "bookmarks").alias("saved"), F.lit(signal == "likes").alias("liked"))

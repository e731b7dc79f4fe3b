"""The engine's item model over the tables at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybreak.functions.text import collapse, first_line, page_title, strip_tags
from daybreak.functions.times import seconds
from daybreak.functions.urls import host
from daybreak.session import table


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    tier = F.when(F.col("doc_id") % 3 == 0, "primary").when(F.col("doc_id") % 3 == 1, "trusted_secondary").otherwise("discovery_only")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"),
        "source",
        "lang",
        F.when(F.col("doc_id") % 5 != 0, "feed_item").otherwise("document").alias("kind"),
        F.substring(collapse(first_line(F.col("text"))), 1, 80).alias("title"),
        F.col("text").alias("body"),
        tier.alias("tier"),
        F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False)).alias("saved"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("unresolved"),
        (F.col("doc_id") % 7 == 0).alias("future"),
    )


ITEMS_SQL = r"""
items AS (
  SELECT d.doc_id, 'doc:' || d.doc_id AS id, d.source, d.lang, CASE WHEN d.doc_id % 5 <> 0 THEN 'feed_item' ELSE 'document' END AS kind,
    left(trim(regexp_replace(split_part(d.text, chr(10), 1), '[\s\v\pZ\x1c-\x1f\x85]+', ' ', 'g')), 80) AS title, d.text AS body,
    CASE d.doc_id % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'trusted_secondary' ELSE 'discovery_only' END AS tier,
    coalesce(l.quality = 1 AND l.toxic = 0, false) AS saved, coalesce(l.toxic = 1, false) AS unresolved, d.doc_id % 7 = 0 AS future
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("id"), host(F.col("url")).alias("source"), "url", page_title(F.col("html")).alias("title"), strip_tags(F.col("html")).alias("body"))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with whole seconds and the number in their properties."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", seconds("ts").alias("sec"), F.get_json_object("props", "$.k").cast("int").alias("k"))


EVENTS_SQL = """
ev AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000000 AS sec, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_rows(spark, sf_dir)
    return e.select("user_id", "event_id", "sec", (35 + F.col("k") / 1000).alias("lat"), (139 + F.col("value") / 1000).alias("lon"), (10 + F.col("k") * 20).cast("double").alias("accuracy"), F.pmod(F.col("value"), F.lit(3.0)).alias("velocity"))


POINTS_SQL = (
    EVENTS_SQL
    + """, pt AS (
  SELECT user_id, event_id, sec, 35 + k / 1000 AS lat, 139 + value / 1000 AS lon, (10 + k * 20)::DOUBLE AS accuracy, fmod(value, 3.0) AS velocity FROM ev
)"""
)


def rounded(x: Column, places: int = 3) -> Column:
    return F.round(x, places)

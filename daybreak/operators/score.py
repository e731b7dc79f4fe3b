"""Candidate scoring, kinds, sections and their top items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AUTHORITY = {"primary": 2.0, "trusted_secondary": 1.0, "discovery_only": 0.5}
SECTIONS = ("today", "followup", "resurface", "incoming", "feed_updates")


def scored(items: DataFrame) -> DataFrame:
    """Adds score, reasons, kind and section. Future relevance weighs 4, an open loop 3, authority of feed items up to 2, intent 1.5."""
    feed = F.col("kind") == "feed_item"
    authority = F.when(feed, F.coalesce(*(F.when(F.col("tier") == t, F.lit(w)) for t, w in AUTHORITY.items()), F.lit(0.0))).otherwise(0.0)
    score = F.when(F.col("future"), 4.0).otherwise(0.0) + F.when(F.col("unresolved"), 3.0).otherwise(0.0) + authority + F.when(F.col("saved"), 1.5).otherwise(0.0)
    reasons = F.filter(
        F.array(F.when(F.col("future"), "future_relevance"), F.when(F.col("unresolved"), "open_loop"), F.when(feed & F.col("tier").isin(*AUTHORITY), F.concat(F.lit("authority:"), F.col("tier"))), F.when(F.col("saved"), "explicit_intent")),
        lambda x: x.isNotNull(),
    )
    kind = F.when(F.col("future"), "today").when(F.col("unresolved"), "followup").when(F.col("saved"), "resurface").otherwise("incoming")
    out = items.withColumns({"score": score, "reasons": reasons, "candidate_kind": kind})
    section = F.when((F.col("candidate_kind") == "incoming") & F.exists("reasons", lambda r: r.startswith("authority:")), "feed_updates").otherwise(F.col("candidate_kind"))
    return out.withColumn("section", section)


def top_per_section(candidates: DataFrame, most: int = 3) -> DataFrame:
    order = Window.partitionBy("section").orderBy(F.desc("score"), "id")
    return candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def first_item(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Each (candidate_id, item_ids) with its first item id that is in `items`; the candidate's own id where none is."""
    listed = candidates.select("candidate_id", F.posexplode("item_ids").alias("pos", "item_id"))
    known = listed.join(items.select(F.col("id").alias("item_id")).distinct(), "item_id", "left_semi")
    first = known.groupBy("candidate_id").agg(F.min_by("item_id", "pos").alias("item_id"))
    return candidates.join(first, "candidate_id", "left").select("candidate_id", F.coalesce("item_id", "candidate_id").alias("item_id"))

"""Digest queries: scoring, sections, picks and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybreak.functions.text import truncate
from daybreak.operators.bindings import ITEMS_SQL, document_items
from daybreak.operators.dedupe import first_wins
from daybreak.operators.score import first_item, scored, top_per_section

SCORED_SQL = (
    "WITH "
    + ITEMS_SQL
    + """, sc AS (
  SELECT *, CASE WHEN future THEN 4e0 ELSE 0e0 END + CASE WHEN unresolved THEN 3e0 ELSE 0e0 END
    + CASE WHEN kind = 'feed_item' THEN CASE tier WHEN 'primary' THEN 2e0 WHEN 'trusted_secondary' THEN 1e0 ELSE 5e-1 END ELSE 0e0 END
    + CASE WHEN saved THEN 1.5e0 ELSE 0e0 END AS score,
    CASE WHEN future THEN 'today' WHEN unresolved THEN 'followup' WHEN saved THEN 'resurface' ELSE 'incoming' END AS candidate_kind,
    concat_ws(',', CASE WHEN future THEN 'future_relevance' END, CASE WHEN unresolved THEN 'open_loop' END,
      CASE WHEN kind = 'feed_item' THEN 'authority:' || tier END, CASE WHEN saved THEN 'explicit_intent' END) AS reasons
  FROM items
), s AS (
  SELECT *, CASE WHEN candidate_kind = 'incoming' AND kind = 'feed_item' THEN 'feed_updates' ELSE candidate_kind END AS section FROM sc
)
"""
)


def _unique_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_wins(document_items(spark, sf_dir), ["body"], "doc_id")


def digest_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_per_section(scored(_unique_items(spark, sf_dir)))
    return top.select("section", "place", "id", "score", F.array_join("reasons", ",").alias("reasons"), "title")


DIGEST_SQL = (
    SCORED_SQL
    + """, u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id) = 1),
r AS (SELECT *, (row_number() OVER (PARTITION BY section ORDER BY score DESC, id))::INTEGER AS place FROM u)
SELECT section, place, id, score, reasons, title FROM r WHERE place <= 3
"""
)


def candidates_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(document_items(spark, sf_dir)).select("id", "score", "candidate_kind", "section", F.array_join("reasons", ",").alias("reasons"))


def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(document_items(spark, sf_dir)).groupBy("section").agg(F.count("*").alias("n"), F.max("score").alias("best"))


def section_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate's place in its section."""
    return top_per_section(scored(document_items(spark, sf_dir)), 1 << 30).select("section", "place", "id")


def per_source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 items of each source in document order."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return document_items(spark, sf_dir).withColumn("place", place).where("place <= 20").select("source", "place", "id")


def primary_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source the primary item: primary tier first, then the id."""
    rank = F.when(F.col("tier") == "primary", 0).otherwise(1)
    return first_wins(document_items(spark, sf_dir), ["source"], rank, "id").select("source", "id", "tier")


def secondary_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the primary pick: a document, else an item of another tier than primary, else any other; then the place."""
    items = document_items(spark, sf_dir)
    rest = items.join(primary_pick(spark, sf_dir).select("id"), "id", "left_anti")
    rank = F.when(F.col("kind") == "document", 0).when(F.col("tier") != "primary", 1).otherwise(2)
    return first_wins(rest, ["source"], rank, "doc_id").select("source", "id", "kind", "tier")


def item_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = document_items(spark, sf_dir)
    open_loop, intent = F.col("unresolved"), F.col("saved")
    return items.groupBy("source").agg(*(F.count_if(p).alias(n) for n, p in (("open_loops", open_loop), ("intents", intent), ("future", F.col("future")), ("feeds", F.col("kind").isin("feed_item")), ("any_flag", open_loop | intent | F.col("future")))))


def candidate_first_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = document_items(spark, sf_dir)
    candidates = items.select(F.concat(F.lit("cand:"), "doc_id").alias("candidate_id"), F.array(*(F.concat(F.lit("doc:"), (F.col("doc_id") + d).cast("string")) for d in (1, 2, 3))).alias("item_ids"))
    return first_item(candidates, items.where("kind = 'document'"))


def compact_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_items(spark, sf_dir).select("id", "title", truncate(F.col("body"), 280).alias("body"))


def ids_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = document_items(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", "id")))
    return items.groupBy("source").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x.id), ",").alias("ids"))


QUERIES = {f.__name__: f for f in (digest_topk, candidates_scored, section_counts, section_bundle, per_source_cap, primary_pick, secondary_pick, item_predicates, candidate_first_item, compact_projection, ids_by_source)}

ORACLES = {
    "digest_topk": DIGEST_SQL,
    "candidates_scored": SCORED_SQL + "SELECT id, score, candidate_kind, section, reasons FROM s",
    "section_counts": SCORED_SQL + "SELECT section, count(*) AS n, max(score) AS best FROM s GROUP BY section",
    "section_bundle": SCORED_SQL + "SELECT section, (row_number() OVER (PARTITION BY section ORDER BY score DESC, id))::INTEGER AS place, id FROM s",
    "per_source_cap": "WITH " + ITEMS_SQL + " SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INTEGER AS place, id FROM items QUALIFY place <= 20",
    "primary_pick": "WITH " + ITEMS_SQL + " SELECT source, id, tier FROM items QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN tier = 'primary' THEN 0 ELSE 1 END, id) = 1",
    "secondary_pick": "WITH "
    + ITEMS_SQL
    + """, p AS (SELECT id FROM items QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN tier = 'primary' THEN 0 ELSE 1 END, id) = 1)
SELECT source, id, kind, tier FROM items WHERE id NOT IN (SELECT id FROM p)
QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN kind = 'document' THEN 0 WHEN tier <> 'primary' THEN 1 ELSE 2 END, doc_id) = 1""",
    "item_predicates": "WITH " + ITEMS_SQL + " SELECT source, count_if(unresolved)::BIGINT AS open_loops, count_if(saved)::BIGINT AS intents, count_if(future)::BIGINT AS future, count_if(kind = 'feed_item')::BIGINT AS feeds, count_if(unresolved OR saved OR future)::BIGINT AS any_flag FROM items GROUP BY source",
    "candidate_first_item": "WITH "
    + ITEMS_SQL
    + """, c AS (SELECT 'cand:' || doc_id AS candidate_id, doc_id, unnest([1, 2, 3]) AS d FROM items),
m AS (SELECT c.candidate_id, arg_min(i.id, c.d) AS item_id FROM c JOIN items i ON i.doc_id = c.doc_id + c.d AND i.kind = 'document' GROUP BY 1)
SELECT DISTINCT c.candidate_id, coalesce(m.item_id, c.candidate_id) AS item_id FROM c LEFT JOIN m USING (candidate_id)""",
    "compact_projection": "WITH "
    + ITEMS_SQL
    + r""", f AS (SELECT id, title, trim(regexp_replace(body, '[\s\v\pZ\x1c-\x1f\x85]+', ' ', 'g')) AS b FROM items)
SELECT id, title, CASE WHEN length(b) > 280 THEN substr(b, 1, 279) || '…' ELSE b END AS body FROM f""",
    "ids_by_source": "WITH " + ITEMS_SQL + " SELECT source, count(*) AS n, string_agg(id, ',' ORDER BY doc_id) AS ids FROM items GROUP BY source",
}

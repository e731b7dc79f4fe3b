"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as
the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybreak.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from daybreak.llm.common import fresh, stored, table


def columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the model learns from the labels of the documents at hand.

    A null or empty text has the prior's score; rows that share an id are scored each for itself; a text of any length is
    scored whole; equal texts score alike; an empty table stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = fresh("toxicity", docs)
    return toxicity.scored_rows(docs, model, score_col=score).where(F.col(score) < 0.5).select(*columns(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; a document of which nothing but white space is left goes.

    Null and empty texts stay as they are; exact repeats of a row keep the same lines; n_chars, where there is one, follows the text.
    """
    removed = fresh("removed_lines", docs)
    out = line_dedup.dedup_lines(docs, removed_col=removed)
    cut = F.size(removed) > 0
    out = out.where(~F.coalesce(cut & ~F.col("text").rlike(r"\S"), F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group, that of the smallest id; of rows that agree in id and text one stays.

    Null and empty texts, and texts without words, are in no group and stay; rows that share an id and differ in text are documents of their own.
    """
    return near_dedup.first_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts stay; of rows that share an id those go that contain an item; an empty benchmark leaves every row.
    """
    key = fresh("row_key", docs)
    hits = decontaminate.contained_rows(docs, table(spark, sf_dir, "benchmark")).select(F.col("row").alias(key)).distinct()
    return docs.withColumn(key, near_dedup.row_key("doc_id", "text")).join(hits, key, "left_anti").select(*columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences of 2048 tokens.

    A null or empty text has its end id; rows that share an id are packed each for itself; other columns are ignored.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL expresses the learned filter and the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The pipeline's stages on a small folder of tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from daybreak.llm import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    whole = " ".join(f"word{i}" for i in range(60))
    extra = [(9000, whole, "en", "s", 1), (9000, whole, "en", "s", 1), (9001, whole + " end", "en", "s", 1), (9002, None, None, None, None), (9003, "", "en", "s", 0), (None, "no id at all here", "en", "s", 3)]
    spark.createDataFrame(docs.collect() + [tuple(r) for r in extra], docs.schema).write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return out


def test_stages_keep_the_columns_and_filter(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes, name
        out.write.parquet(f"{folder}/{name}.out")
        before, docs = docs, spark.read.parquet(f"{folder}/{name}.out")
        if name == "toxicity":
            assert docs.join(before, "doc_id").count() > 0 and docs.count() <= before.count()
        if name == "near_dedup":
            ids = [r.doc_id for r in docs.where("doc_id >= 9000").collect()]
            assert 9001 not in ids and ids.count(9000) <= 1
        if name == "packing":
            assert docs.agg(F.sum("length")).first()[0] == docs.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).agg(F.sum("n")).first()[0]


def test_every_query_is_registered():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

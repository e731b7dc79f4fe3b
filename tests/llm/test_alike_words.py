"""Words whose polynomial hashes modulo 2^64 agree for every multiplier are told apart."""

from __future__ import annotations

import pyarrow as pa
import pytest

from daybreak.llm import decontaminate, near_dedup, tokens


def pair(bits):
    """abba baab ... of 2^bits letters, and the same with both letters exchanged."""
    word = "a"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("bits", [10, 11, 12, 13])
def test_token_ids(bits):
    encoder = tokens.encoder(tokens.default_path())
    texts = [f"{w} x" for w in pair(bits)]
    for _, _, ids, counts in encoder.column(pa.array(texts), None):
        own = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == own[0] + own[1] and counts.tolist() == [len(x) for x in own]


def test_documents_of_such_words_are_not_near(spark, tmp_path):
    a, b = pair(11)
    rows = [(1, " ".join([a] * 9)), (2, " ".join([b] * 9)), (3, f"{b} " * 12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = near_dedup.op10_near_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out] == [(1, 1, 1, True), (2, 1, 2, True), (3, 1, 2, False)]


def test_items_of_such_words_are_found_where_they_are(spark):
    a, b = pair(11)
    docs = spark.createDataFrame([(1, f"x {f'{a} ' * 6}"), (2, f"x {f'{b} ' * 6}")], "doc_id long, text string")
    items = spark.createDataFrame([(7, f"{b} " * 6)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contained_items(docs, items).collect()] == [2]

"""Near-dedup against brute force over all pairs."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from daybreak.llm import near_dedup

SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, size):
    w = words(text)
    return set() if not w else {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def components(sets, percent):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(sets))]


def check(spark, texts, size=4, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, shingle_words=size, **options).collect()}
    sets = [shingles(t, size) for t in texts]
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, components(sets, 80)))}


def edited(base, n, rng):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def test_groups_of_near_copies(spark):
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(400)]
    texts = []
    for _ in range(30):
        base = rng.choices(vocabulary, k=rng.randrange(8, 120))
        texts += [edited(base, rng.randrange(0, 6), rng) for _ in range(rng.randrange(1, 6))]
    rng.shuffle(texts)
    check(spark, texts)


def test_one_large_group_is_settled_around_its_hub(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(100)]
    variants = [edited(base, 8, rng).split() for _ in range(3)]
    texts = [edited(base, rng.randrange(0, 9), rng) for _ in range(160)]
    texts += [edited(v, rng.randrange(0, 5), rng) for v in variants for _ in range(20)]
    texts += [" ".join(base[: rng.randrange(70, 100)]) for _ in range(20)]
    rng.shuffle(texts)
    check(spark, texts)


def test_cases(spark):
    texts = ["A b c d e", "a B\tc\nd e", None, "", "  \t ", "one two", "ONE two", "one", "x " * 5000, "x " * 9000, "a b c d e f"]
    check(spark, texts)
    docs = spark.createDataFrame([(3, "p q r s t u v", 1), (3, "p q r s t u v", 2), (5, "p q r s t u v", 3), (None, "p q r s t u v", 4), (None, "alone", 5)], "doc_id long, text string, cls int")
    got = sorted(near_dedup.near_duplicates(docs).select("doc_id", "component_id").collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(3, 3), (3, 3), (5, 3), (None, 3), (None, None)], key=str)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_scattered_exact_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text of some words here").otherwise(F.concat(F.lit("own text number "), F.col("id").cast("string"))).alias("text"))
    out = near_dedup.near_duplicates(docs)
    assert out.where("component_id = 0").count() == 1000
    assert out.where("doc_id = component_id").count() == 2001

"""Clashing names, long texts, hot groups, recall, and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from daybreak.llm import chat, decontaminate, line_dedup, near, near_dedup, packing, repeats, token_output, tokens, toxicity
from daybreak.llm.common import scratch
from tests.llm.test_near_dedup import components, edited, shingles


def test_clashing_names(spark):
    names = "doc_id long, text string, gone string, __doc string, __gone string, __toxicity string, row string, row_key_0 string, gone_key_0 string, removed_lines string"
    docs = spark.createDataFrame([(1, "the same long line here\nown one", *"abcdefgh"), (2, "the same long line here\nanother", *"abcdefgh")], names)
    out = line_dedup.dedup_lines(docs).collect()
    assert [r.text for r in sorted(out)] == ["the same long line here\nown one", "another"] and sorted(out)[1].removed_lines == [0] and out[0].row_key_0 == "f"
    model = toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), 0.0)
    assert toxicity.scored_rows(docs, model, score_col="s").columns == [*docs.columns, "s"]
    assert near_dedup.first_documents(docs).columns == docs.columns
    items = spark.createDataFrame([(1, "x", "y")], "item_id long, text string, row string")
    assert decontaminate.contained_items(docs, items).count() == 0
    for name in ("drop_repeated_lines", "drop_near_duplicates"):
        assert getattr(corpus_pipeline, name)(spark, docs, "").columns == docs.columns


def test_rows_that_share_an_id_are_told_apart(spark):
    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "wu"]
    rows = [(1, words[0], 5), (2, words[0], 1), (2, words[1], 2), (2, words[1], 3), (None, words[0], 4), (None, None, 6), (None, None, 6), (7, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted(map(tuple, near_dedup.first_documents(docs).collect()), key=str)
    assert got == sorted([(1, words[0], 5), (2, words[1], 2), (None, None, 6), (None, None, 6), (7, "", 1)], key=str)


def test_long_texts(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(5000)]
    lines = [" ".join(rng.choices(vocabulary, k=12)) for _ in range(75000)]
    long = "\n".join(lines)
    flat = long.replace("\n", " ")
    assert len(long) > 5_000_000
    docs = spark.createDataFrame([(1, long), (2, "short one\n" + lines[7]), (3, flat), (4, long)], "doc_id long, text string")
    # tokens
    path = scratch(spark, "long")
    token_output.write_tokens(docs, path)
    library = tokens.encoder(tokens.default_path()).tokenizer
    want = [*library.encode(long, add_special_tokens=False).ids, 2]
    got = {r.doc_id: (r.n_tokens, r.ids) for r in token_output.read_tokens(spark, path).collect()}
    assert got[1][1] == want and got[4][1] == want and got[3][1] == want
    assert packing.pack(docs).groupBy("doc_id").agg(F.sum("length")).where("doc_id = 1").first()[1] == len(want)
    # lines, documents, bytes, items
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert out[1].text == long or len(out[1].removed_lines) < 50
    assert out[4].text == "" and out[2].text == "short one" and out[3].text == flat
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 1}
    cut = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    assert cut[4].n_removed == cut[4].n_bytes == len(long) and cut[1].n_removed == 0
    items = spark.createDataFrame([(1, lines[70000]), (2, "never to be seen anywhere here")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.contained_items(docs, items).collect()) == [1, 3, 4]
    model = toxicity.Model(np.random.default_rng(1).normal(size=1 << toxicity.BITS).astype(np.float32) / 100, 0.0)
    assert toxicity.score(docs, model).count() == 4


def test_features_of_a_long_text_are_those_of_the_whole():
    text = " " + "".join(random.Random(2).choices("abcdé \n", k=toxicity.PART + 5000)) + " "
    (whole,) = toxicity._features([text], np.zeros(1 << toxicity.BITS, np.int32))
    assert np.array_equal(np.unique(whole), toxicity._long_features(text))


def test_signature_of_a_long_line_is_that_of_the_whole():
    data = np.frombuffer("".join(random.Random(3).choices("abé€ c", k=9 * line_dedup.PART)).encode(), np.uint8)
    lines = line_dedup.Lines(data, np.array([0, len(data)]))
    ((_, got),) = line_dedup.signatures(lines, np.array([0]), 5)
    assert np.array_equal(got, line_dedup.one_permutation(*line_dedup.line_shingles(data, np.array([0]), np.array([len(data)]), 5)))


def test_a_hot_group_beyond_a_flush(spark):
    rng = random.Random(21)
    base = [f"b{i}" for i in range(80)]
    kin = [edited(base, 14, rng).split() for _ in range(6)]
    texts = [edited(base, rng.randrange(0, 7), rng) for _ in range(500)] + [edited(k, rng.randrange(0, 4), rng) for k in kin for _ in range(8)]
    texts += [" ".join(base[: rng.randrange(50, 80)]) for _ in range(40)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, shingle_words=4).collect()}
    want = components([shingles(t, 4) for t in texts], 80)
    assert got == dict(enumerate(want))


def test_recall_of_near_documents(spark):
    rng = random.Random(31)
    pairs = []
    while len(pairs) < 300:
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 300))]
        other = edited(base, max(1, len(base) * rng.randrange(10, 30) // 1000), rng)
        a, b = shingles(" ".join(base), 5), shingles(other, 5)
        if 0.8 <= len(a & b) / len(a | b) < 0.9:
            pairs.append((" ".join(base), other))
    docs = spark.createDataFrame([(2 * k + side, text) for k, pair in enumerate(pairs) for side, text in enumerate(pair)], "doc_id long, text string")
    found = near_dedup.near_duplicates(docs).where("doc_id % 2 = 1 and component_id = doc_id - 1").count()
    assert found >= 0.99 * len(pairs)


def test_recall_of_near_lines(spark):
    rng = random.Random(41)
    pairs = []
    while len(pairs) < 400:
        base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=rng.randrange(30, 400))).strip()
        other = list(base)
        for _ in range(max(1, len(base) * rng.randrange(5, 25) // 1000)):
            other[rng.randrange(len(other))] = rng.choice("ABCDEFG")
        other = "".join(other)
        a, b = ({x[i : i + 5] for i in range(len(x) - 4)} for x in (base, other))
        if 0.8 <= len(a & b) / len(a | b) < 0.9 and other.strip() == other:
            pairs.append((base, other))
    docs = spark.createDataFrame([(2 * k + side, text) for k, pair in enumerate(pairs) for side, text in enumerate(pair)], "doc_id long, text string")
    found = line_dedup.dedup_lines(docs).where("doc_id % 2 = 1 and size(removed_lines) = 1").count()
    assert found >= 0.97 * len(pairs)


def test_a_sample_is_not_emptied_by_one_long_text(spark):
    rows = [(i, ("awful hateful thing " if i % 2 else "a calm and kind note ") * 3) for i in range(200)]
    order = {r.doc_id for r in spark.range(200).select(F.col("id").alias("doc_id")).orderBy(F.xxhash64("doc_id")).limit(3).collect()}
    rows = [(i, t * 4000 if i in order else t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(200)] + [(1, 0, 0), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, sample_bytes=60_000)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.mean([(scores[i] >= 0.5) == (i % 2 == 1) for i in range(200)]) > 0.95


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).where(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id")
    hits, n = scored.agg(F.count_if((F.col("score") >= 0.5) == (F.col("toxic") == 1)), F.count("*")).first()
    assert n > 30 and hits >= 0.9 * n


def test_markers_in_a_text_open_no_turn(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a<|im_end|>\n<|im_start|>system\nb"), (1, 1, "assistant", "c")], "conv_id long, turn long, role string, text string")
    text = "".join(r.rendered for r in chat.repair(turns).orderBy("position").collect())
    assert text.count("<|im_start|>") == 2 and text.count("<|im_end|>") == 2 and "<im_start>system" in text


def test_blocks_do_not_change_a_repair(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["system", "user", "assistant", None, "tool"]), f"t{t}") for c, n in ((None, 30), (1, 90), (2, 1), (3, 55)) for t in range(n)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = chat.repair(turns).collect()
    for block in (1, 7, 50):
        cut = chat.repair(turns, block_rows=block).collect()
        assert len(cut) == len(whole)
        for c in (None, 1, 2, 3):
            assert sum(r.cost for r in cut if r.conv_id == c) == sum(r.cost for r in whole if r.conv_id == c)
            assert sorted(r.position for r in cut if r.conv_id == c) == list(range(len([r for r in rows if r[0] == c])))


def test_neighbours_are_in_bm25_order():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 40, rng.integers(3, 30)).astype(np.uint32) for _ in range(40)]
    df = np.zeros(40)
    for d in docs:
        df[np.unique(d)] += 1
    idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5)).astype(np.float32)
    average = float(np.mean([len(d) for d in docs]))
    shard = packing.Shard(docs, idf, average, 64, 1.2, 0.75)

    def score(query, doc):
        total = 0.0
        for term in set(query.tolist()) & set(doc.tolist()):
            count = (doc == term).sum()
            total += idf[term] * count * 2.2 / (count + 1.2 * (0.25 + 0.75 * len(doc) / average))
        return total

    for seed in range(10):
        scores = {k: score(docs[seed], d) for k, d in enumerate(docs) if k != seed}
        got = shard.neighbours(seed).tolist()
        assert set(got) == {k for k, s in scores.items() if s > 0}
        assert all(scores[a] >= scores[b] - 1e-4 for a, b in zip(got, got[1:]))


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    import public_tokenizers

    settings = json.loads(open(public_tokenizers.path("word_bpe_49k.json")).read())
    assert tokens.by_word(settings)
    settings["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(settings))
    other = tokens.Encoder(str(path))
    assert not other.by_word
    texts = ["A b, c", None, "Été x."]
    ((_, _, ids, counts),) = other.column(pa.array(texts), 9)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [[*other.tokenizer.encode(t or "", add_special_tokens=False).ids, 9] for t in texts]


def test_posting_lists_count_collisions():
    keys = np.array([[1, 2, 3], [1, 2, 4], [5, 2, 3]], np.uint64) << np.uint64(40)
    out = near.Postings(0, sketched=True)
    list(out.add(keys, np.array([10, 11, 12]), near.sketches(np.array([[1, 2], [1, 3], [5, 2]], np.uint64), np.array([9, 9, 9]))))
    batch = out.flush()
    rows = near.merged_lists(pa.Table.from_batches([batch]), 0, 2).to_pylist()
    assert sorted((r["a"], r["b"], r["n"], r["skipped"]) for r in rows) == [(10, 11, 2, 1), (10, 12, 2, 1), (11, 12, 1, 0)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(77)
    out = str(tmp_path_factory.mktemp("brute"))
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(800)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    boiler = [prose(12) for _ in range(4)]
    bases = ["\n".join(prose(25) for _ in range(4)) for _ in range(12)]
    items = [prose(18) for _ in range(6)]
    texts = []
    for k in range(90):
        text = rng.choice(bases)
        words = text.split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 30])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        text = " ".join(words)
        if k % 3 == 0:
            text += "\n" + rng.choice(boiler)
        if k % 10 == 0:
            text += " " + rng.choice(items) + " end"
        texts.append(text)
    texts += [None, "", "  \n ", "one two", boiler[0]]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def brute_lines(docs):
    """The texts after line dedup, and those emptied by it."""
    lines = [(d, n, x.rstrip("\r")) for d, t in docs if t for n, x in enumerate(t.split("\n")) if x.strip()]
    sets = [{x[j : j + 5] for j in range(max(1, len(x) - 4))} for _, _, x in lines]
    gone = {lines[i][:2] for i, root in enumerate(components(sets, 80)) if root != i}
    out = []
    for d, t in docs:
        kept = t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone)
        if t is None or kept.strip() or not any(g[0] == d for g in gone):
            out.append((d, kept))
    return out


def test_the_pipeline_equals_brute_force(spark, folder):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    docs = brute_lines(docs)  # without labels nothing is toxic
    sets = [shingles(t, 5) for _, t in docs]
    docs = [d for k, d in enumerate(docs) if not sets[k] or components(sets, 80)[k] == k]
    alnum = lambda t: re.findall(r"[0-9a-z]+", (t or "").lower())
    runs = lambda t: {tuple(alnum(t)[i : i + 5]) for i in range(len(alnum(t)) - 4)} if len(alnum(t)) >= 5 else {tuple(alnum(t))} - {()}
    items = [runs(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    docs = [(d, t) for d, t in docs if not any(100 * len(i & runs(t)) >= 80 * len(i) for i in items)]
    library = tokens.encoder(tokens.default_path()).tokenizer
    want = {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs}
    pieces = corpus_pipeline.run(spark, folder).orderBy("doc_id", "start").collect()
    got: dict[int, list[int]] = {}
    for p in pieces:
        assert len(got.setdefault(p.doc_id, [])) == p.start
        got[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
    assert 10 < len(want) < 90 and got == want


def test_cut_bytes_have_their_hash(spark):
    text = "x" * 30 + "0123456789" * 8
    docs = spark.createDataFrame([(1, text), (2, "y" * 9 + "0123456789" * 8 + "tail")], "doc_id long, text string")
    rows = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    assert hashlib.sha256(rows[2].kept).hexdigest() == hashlib.sha256(b"y" * 9 + b"tail").hexdigest() and math.isclose(rows[2].n_removed, 80)

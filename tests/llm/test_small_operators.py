"""Cases and brute force for the operators that need no large fixture."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daybreak.llm import chat, decontaminate, inner_product, line_dedup, packing, repeats, token_output, tokens, toxicity, warc
from daybreak.llm.common import scratch

DOCS = "doc_id long, text string, ids string, part int"
TEXTS = ["Hello, the world's 12 words.", None, "", "same", "same", "the <|endoftext|> mark", "x " * 3000, "É́ İstanbul, ﬁ\x00ᄀ"]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeats, and columns whose names clash with those used inside."""
    return spark.createDataFrame([(i if i != 4 else 3, t, "clash", 9) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None)], DOCS)


def reference_ids(text, end):
    return [*tokens.encoder(tokens.default_path()).tokenizer.encode(text or "", add_special_tokens=False).ids, end]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aZéÉ .,'s\n\t0<|>", "\u0301", "İ", "ﬁ", "\xa0", "\x1c", "中", "<|endoftext|>", "ᄀ", "ᅡ"])).map("".join), min_size=1, max_size=8))
def test_pieces_give_the_ids_of_whole_texts(texts):
    for _, _, ids, counts in tokens.encoder(tokens.default_path()).column(pa.array(texts), 7):
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [reference_ids(t, 7) for t in texts]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, docs, encoding):
    path = token_output.write_tokens(docs, scratch(spark, "t"), encoding=encoding)
    out = token_output.read_tokens(spark, path).orderBy("start").collect()
    stream = [i for r in out for i in r.ids]
    assert [r.start for r in out] == [0, *itertools.accumulate(r.n_tokens for r in out)][:-1]
    assert sorted((str(r.doc_id), r.ids) for r in out) == sorted((str(r.doc_id), reference_ids(r.text, 2)) for r in docs.collect())
    assert [r.doc_id for r in out] == [None, 0, 1, 2, 3, 3, 5, 6, 7]
    part = token_output.read_token_range(spark, path, 5, 40).orderBy("start").collect()
    assert [i for r in part for i in r.ids] == stream[5:40]
    assert token_output.read_tokens(spark, path, [3], with_ids=False).count() == 2


def test_token_files_of_an_empty_table(spark, docs):
    path = token_output.write_tokens(docs.limit(0), scratch(spark, "t"))
    assert token_output.read_tokens(spark, path).count() == 0


@pytest.mark.parametrize("shard", [64, 1 << 19])
def test_packing_places_every_token_once(spark, docs, shard):
    pieces = packing.pack(docs, window=32, shard_tokens=shard).collect()
    got: dict = {}
    for p in sorted(pieces, key=lambda p: (str(p.doc_id), p.start)):
        got.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    tokens_by_length = sorted(tuple(reference_ids(r.text, 1)) for r in docs.where("doc_id is null or doc_id <> 3").collect())
    assert sorted(tuple(i for p in ps for i in np.frombuffer(p.ids, "<u4")) for (d, _), ps in got.items() if d != 3) == tokens_by_length
    for _, group in itertools.groupby(sorted(pieces, key=lambda p: (p.sequence_id, p.offset)), key=lambda p: p.sequence_id):
        end = 0
        for p in group:
            assert p.offset == end
            end += p.length
        assert end <= 32 and end & (end - 1) == 0
    whole = packing.sequences(packing.pack(docs, window=32)).collect()
    assert sum(r.length for r in whole) == sum(len(reference_ids(r.text, 1)) for r in docs.collect())
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_deals_near_documents_into_one_shard(spark):
    rng = np.random.default_rng(5)
    common = "the of and to in is that for it as was with be by on not he his but at".split()
    texts = [" ".join([*common, *("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(12))]) for _ in range(300)]
    docs = spark.createDataFrame([(i, texts[i % 300]) for i in range(600)], "doc_id long, text string")
    docs = docs.withColumn("text", F.when(F.col("doc_id") >= 300, F.concat("text", F.lit(" again"))).otherwise(F.col("text")))
    tokenized = packing.tokenize(docs, tokens.default_path(), 1).toPandas().sort_values(["signature", "doc_id"])
    shard = {d: at // 20 for at, d in enumerate(tokenized.doc_id)}
    assert np.mean([shard[i] == shard[i + 300] for i in range(300)]) > 0.7


def test_packing_prefers_lexical_neighbours():
    shard = packing.Shard([np.array(x, np.uint32) for x in ([1, 2, 3], [7, 8, 9], [2, 3, 4], [9, 9, 7])], np.ones(10, np.float32), 3.0, 8, 1.2, 0.75)
    assert shard.neighbours(0).tolist() == [2] and shard.neighbours(1).tolist() == [3]


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ b", b"<p>x</p>"), (2, None, b"<p>x</p>"), (3, "u", None), (4, "u", b""), (5, "u", "é\r\n\r\nWARC/1.1".encode()), (5, "v", b"other"), (None, "u", b"<p>x</p>"), (9, "u", b"z" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "record_id long, url string, payload binary, digest string")
    path = scratch(spark, "w")
    index = warc.write_warc(pages.repartition(3), path, frame_bytes=300)
    assert index.count() == len(rows)
    got = sorted(((r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_warc(spark, path).collect()), key=str)
    want = [(1, "response", None, 8), (2, "revisit", 1, 8), (3, "response", None, 0), (4, "revisit", 3, 0), (5, "response", None, 14), (5, "response", None, 5), (None, "revisit", 1, 8), (9, "response", None, 3_000_000)]
    assert got == sorted(want, key=str)
    assert warc.read_record(index, 9).payload == b"z" * 3_000_000 and warc.read_record(index, 2).payload is None and warc.read_record(index, 77) is None
    assert warc.read_record(index, 1).url == "http://a/%20b"
    least = scratch(spark, "w")
    warc.write_warc(pages, least, least_bytes=1)
    assert {r.record_type for r in warc.read_warc(spark, least).where("record_id in (3, 4)").collect()} == {"response"}
    empty = scratch(spark, "w")
    warc.write_warc(pages.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_top_products_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=6) * rng.choice([0.1, 1, 5])]) for i in range(600)]
    vectors += [(600 + i, vectors[i % 7][1]) for i in range(40)] + [(0, vectors[0][1])]
    vectors += [(900, None), (901, [1.0, None] + [0.0] * 4), (1000, [float("nan")] * 6), (1001, [float("inf")] * 6), (None, [1.0] * 6), (1002, [])]
    frame = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<double>, v int")
    out = inner_product.top_inner_products(inner_product.integer_vectors(frame), F.col("vec_id") % 100 == 0, k=10, query_block=3)
    ints = [(i, np.array([int(np.floor(1024 * x)) for x in v] or [0] * 6)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for at, (q, own) in enumerate(ints):
        if q % 100 == 0:
            best = sorted((-int(own @ v), i) for k, (i, v) in enumerate(ints) if k != at)[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert inner_product.top_inner_products(inner_product.integer_vectors(frame.limit(0)), F.lit(True)).count() == 0


@pytest.mark.parametrize("union", [5, 20, 60, 500])
def test_bands_miss_few_links(union):
    rng = np.random.default_rng(7)
    both, n = union * 4 // 5, 4000
    hashes = rng.integers(0, 1 << 64, (n, union), dtype=np.uint64)
    other = np.concatenate([hashes[:, :both], hashes[:, (both + union) // 2 :]], axis=1)
    keys = []
    for sets in (hashes[:, : (both + union) // 2], other):
        parts = [sets[i : i + 2000] for i in range(0, n, 2000)]
        signatures = np.concatenate([line_dedup.one_permutation(p.ravel(), np.full(len(p), p.shape[1])) for p in parts])
        keys.append(line_dedup.band_keys(signatures, 20, 6))
    assert (keys[0] != keys[1]).all(axis=1).mean() < 0.007


def test_top_products_of_large_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(size=4) * 10.0 ** rng.integers(-1, 5)]) for i in range(200)]
    vectors += [(200, [float(1 << 21), 1.0, 0.0, 0.0]), (201, [-float(1 << 27), 0.0, 3.0, 0.0]), (202, [float(1 << 21), 1.0, 0.0, 0.001])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    near = inner_product.top_inner_products(inner_product.integer_vectors(frame), F.col("vec_id").isin(0, 100, 200), k=5)
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v in vectors}
    want = []
    for q in (0, 100, 200):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, near.collect())) == sorted(want)
    for embedding in ([1e30] * 4, [float(1 << 40), 0.0, 0.0, 0.0], [-float(1 << 40), 0.0, 0.0, 0.0]):
        over = spark.createDataFrame([(0, [float(1 << 40), 0.0, 0.0, 0.0]), (1, embedding)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="fit a long"):
            inner_product.top_inner_products(inner_product.integer_vectors(over), F.col("vec_id") == 0).collect()


def test_toxicity_learns_and_leaves_held_out_rows_alone(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = int(rng.random() < 0.3)
        text = rng.choices(vocabulary, k=60)
        if toxic:
            text[rng.randrange(60)] = rng.choice(["zzgrumf", "qqwurst"])
        rows.append((i, " ".join(text), "clash"))
        labels.append((i, 1, toxic if i % 50 else None))
    docs = spark.createDataFrame(rows + [(1000, None, ""), (1001, "", ""), (None, "no id", "")], "doc_id long, text string, toxic string")
    marks = spark.createDataFrame(labels + labels[:5], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(t, scores[i]) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0 and t is not None]
    assert np.mean([(s >= 0.5) == bool(t) for t, s in held]) > 0.95
    assert scores[1000] == scores[1001] < 0.5 and len(scores) == 603
    assert toxicity.train(docs, marks.limit(0)).score(np.empty(0, np.int32)) < 1e-9
    assert {r.toxicity for r in toxicity.scored_rows(docs.limit(0), model).collect()} == set()


def cheapest(roles, costs):
    """Dijkstra over (turn, state, whether anything stands at the end)."""
    states = {(chat.START): 0}
    for role, known in roles:
        after: dict = {}
        for state, cost in states.items():
            todo = [(state, cost)]
            reached = {state: cost}
            while todo:  # empty turns
                s, c = todo.pop()
                for t in chat.NEXT[s]:
                    if c + costs.insert < reached.get(t, 1 << 30):
                        reached[t] = c + costs.insert
                        todo.append((t, c + costs.insert))
            for s, c in reached.items():
                for target in chat.NEXT[s]:
                    own = c + (0 if target == role and known else costs.relabel)
                    after[target] = min(after.get(target, 1 << 30), own)
            if state != chat.START:
                own = cost + costs.merge + (0 if state == role and known else costs.relabel)
                after[state] = min(after.get(state, 1 << 30), own)
        states = after
    return min(c + chat.ending(s, costs)[0] for s, c in states.items())


@pytest.mark.parametrize("block", [3, 1000])
def test_role_repair_costs_least_and_is_legal(spark, block):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", " System ", "tool", None]), f"t{t}") for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(99, t, "user", "hot") for t in range(30)] + [(None, 0, "user", None)]
    out = chat.repair(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, block string"), block_rows=block).collect()
    assert len(out) == len(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in out if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(len(mine)))
        given_roles = [chat.role_of(r[2]) for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        assert sum(r.cost for r in mine) == cheapest(given_roles, chat.Costs())
        heads = [x.split("\n")[0] for x in "".join(r.rendered for r in mine).split("<|im_start|>")[1:]]
        assert heads[0] in ("system", "user") and heads[-1] == "assistant"
        assert all(b in {"system": ("user",), "user": ("assistant",), "assistant": ("user",)}[a] for a, b in zip(heads, heads[1:]))
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute_repeats(rows, length):
    seen: dict = {}
    out = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        key = float("inf") if i is None else i
        for k in range(len(b) - length + 1):
            if seen.get(b[k : k + length], key) < key:
                gone[k : k + length] = b"\1" * length
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            seen[w] = min(seen.get(w, key), key)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.setdefault(i, []).append((len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return {i: sorted(v) for i, v in out.items()}


def test_repeated_spans_equal_brute_force(spark):
    rng = random.Random(6)
    passages = ["".join(rng.choices("abcd é\x00", k=rng.randrange(40, 200))) for _ in range(12)]
    rows = []
    for i in range(80):
        parts = ["".join(rng.choices("abcdefgh ", k=rng.randrange(0, 120))) for _ in range(3)]
        rows.append((i, parts[0] + rng.choice(passages)[rng.randrange(20) :] + parts[1] + rng.choice(passages) + parts[2]))
    rows += [(200, rows[5][1]), (201, rows[5][1]), (202, "ab" * 400), (203, "ab" * 300), (204, None), (205, ""), (206, "x" * 49), (None, rows[7][1]), (300, passages[0] * 3), (301, passages[0] * 2)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bucket string").repartition(3)
    got: dict = {}
    for r in repeats.remove_repeats(docs, bucket_bytes=4096).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)))
    assert {i: sorted(v) for i, v in got.items()} == brute_repeats(rows, 50)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_interval_tree_gives_every_maximal_repeat():
    rng = random.Random(7)
    data = np.frombuffer("".join(rng.choices("ab", k=120)).encode(), np.uint8)
    starts = np.arange(len(data))
    order, lcp = repeats.suffix_array(data, starts, np.full(len(data), len(data)))
    left = np.array([300 if i == 0 else int(data[i - 1]) for i in order])
    got = {(data[order[a] : order[a] + depth].tobytes(), frozenset(order[a:b].tolist())) for depth, a, b in repeats.maximal_repeats(lcp, left, 3)}
    want = set()
    text = data.tobytes()
    for n in range(3, 119):
        places: dict = {}
        for i in range(len(text) - n + 1):
            places.setdefault(text[i : i + n], []).append(i)
        for s, at in places.items():
            befores = {text[i - 1] if i else None for i in at}
            afters = {text[i + n] if i + n < len(text) else None for i in at}
            if len(at) > 1 and len(befores) > 1 and len(afters) > 1:
                want.add((s, frozenset(at)))
    assert got == want


def test_contained_items_equal_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40)))) for i in range(60)] + [(77, None), (78, ""), (0, "w1 w2 w3 w4 w5 w6")]
    docs = []
    for i in range(60):
        body = rng.choices(vocabulary, k=rng.randrange(0, 300))
        own = rng.choice(items[:60])[1].split()
        for k in range(len(own)):
            if rng.random() < 0.02:
                own[k] = "other"
        docs.append((i, " ".join(body[:50] + own + body[50:]).upper() + "!"))
    docs += [(1, docs[0][1]), (90, None), (91, "")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")

    def sh(t):
        w = (t or "").lower().rstrip("!").split()
        return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = sorted((i, j, len(sh(t)), len(sh(t) & sh(x))) for j, t in items for i, x in docs if sh(t) and 100 * len(sh(t) & sh(x)) >= 80 * len(sh(t)))
    for block in (1 << 21, 50):
        assert sorted(map(tuple, decontaminate.contained_items(d, b, block_shingles=block).collect())) == want
    assert decontaminate.contained_items(d, b.limit(0)).count() == 0 == decontaminate.contained_items(d.limit(0), b).count()


def test_fuzzy_lines_equal_brute_force(spark):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé ", k=rng.randrange(3, 200))) for _ in range(40)]

    def variant():
        line = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            line[rng.randrange(len(line))] = "#"
        return "".join(line) + rng.choice(["", "\r"])

    rows = [(i, "\n".join(rng.choice([variant, lambda: " "])() for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "\n\n"), (5, rows[5][1])]
    out = line_dedup.dedup_lines(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, number int")).collect()
    lines = sorted({(i, k, x.rstrip("\r")) for i, t in rows if t for k, x in enumerate(t.split("\n")) if x.strip()})
    sets = [{x[j : j + 5] for j in range(max(1, len(x) - 4))} if len(x) >= 5 else {x} for _, _, x in lines]
    parent = list(range(len(lines)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(lines)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    gone = {(i, k) for n, (i, k, _) in enumerate(lines) if root(n) != n}
    assert len(out) == len(rows)
    for r in out:
        text = dict(rows)[r.doc_id]
        assert r.removed_lines == sorted(k for i, k in gone if i == r.doc_id)
        assert r.text == (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (r.doc_id, k) not in gone))
        assert r.number == 1
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0

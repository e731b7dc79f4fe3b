"""Filtering Lloyd against plain Lloyd."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from daybreak.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, ids int"


def nearest(point, book):
    return min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(point, book[e])), e))


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    kept = [(i, v + [0] * (parts * width - len(v)), y) for i, v, y in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    for step in range(rounds + 1):
        found = [[nearest(cut(v, p), books[p]) for p in range(parts)] for _, v, _ in kept]
        if step < rounds:
            for p in range(parts):
                for e in range(len(first)):
                    own = [cut(v, p) for (_, v, _), f in zip(kept, found) if f[p] == e]
                    if own:
                        books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    errors = [sum((a - b) ** 2 for p in range(parts) for a, b in zip(cut(v, p), books[p][f[p]])) for (_, v, _), f in zip(kept, found)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    by_label = {}
    for (_, _, y), x in zip(kept, errors):
        by_label[y] = by_label.get(y, 0) + x
    return sorted(((i, "".join(f"{x:02x}" for x in f), x, by_label[y], digest) for (i, _, y), f, x in zip(kept, found, errors)), key=str)


def got(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    out = vector_codes.op13_vector_codes(spark, str(tmp_path))
    assert out.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_random_vectors_and_a_hot_vector(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_codes, "CHUNK_BYTES", 64 * 32 * 4)
    rng = random.Random(3)
    hot = [rng.gauss(0, 0.1) for _ in range(32)]
    rows = [(k, hot if k % 3 == 0 else [rng.gauss(0, 0.1) for _ in range(32)], rng.choice([None, 1, 2])) for k in range(900)]
    want = brute(rows)
    assert got(spark, tmp_path, rows) == want and len(want) == 900


def test_nulls_lengths_ties_repeats(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [0.5] * 7, None), (3, [0.25] * 7, None), (3, [0.5] * 7, 4), (1, None, 1), (0, [nan] * 7, 1), (2, [inf, 1.0], 1), (4, [None, 1.0], 1), (None, [1.0, -2.0], 4), (9, [], 4), (8, [-0.001] * 20, None)]
    assert got(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], None)]])
def test_empty(spark, tmp_path, rows):
    assert got(spark, tmp_path, rows) == brute(rows)


def test_too_large_components_are_an_error():
    with pytest.raises(ArithmeticError):
        vector_codes.kind_for(1 << 31, 4)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(1, 3), st.integers(1, 12), st.sampled_from([1, 3, 50, 1 << 25]), st.integers(0, 99))
def test_walk_is_a_search_of_all_entries(n, width, k, spread, seed):
    rng = np.random.default_rng(seed)
    points, book = rng.integers(-spread, spread, (n, width)).astype(np.int32), rng.integers(-spread, spread, (k, width))
    forest = vector_codes.grow(points, 1)
    forest = vector_codes.planted(n, 1, width, forest.blobs())
    codes, sums, counts = vector_codes.walk(forest, 0, book)
    away = ((points[forest.order[0]].astype(np.int64)[:, None] - book[None]) ** 2).sum(axis=2)
    assert (codes == away.argmin(axis=1)).all() and (counts == np.bincount(codes, minlength=k)).all()
    assert all((sums[e] == points[forest.order[0]][codes == e].sum(axis=0, dtype=np.int64)).all() for e in range(k))

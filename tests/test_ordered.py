"""Operators over ordered groups against row loops; every group of the frames is a case of its own."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from daybreak.operators import cluster, ordered, state


def clusters(items):
    """(pos, cluster) by the definition: the first cluster that shares a token takes the item and its tokens."""
    held, out = [], []
    for pos, tokens in sorted(items, key=lambda x: x[0]):
        found = next((k for k, c in enumerate(held) if c & set(tokens or ())), len(held))
        if found == len(held):
            held.append(set())
        held[found] |= set(tokens or ())
        out.append((pos, found))
    return out


def grouped_cases():
    rng = random.Random(7)
    cases = [[(k, rng.sample("abcdefghijklmnop", rng.randint(0, 3))) for k in range(rng.randint(1, 25))] for _ in range(60)]
    cases.append([(k * 5000, [f"t{k}", f"t{k + 1}"]) for k in range(90)])  # a chain: each item shares with the one before only
    cases.append([(0, ["z"]), *((k + 1, [f"t{k}", f"t{k + 1}"]) for k in range(70)), (80, None), (81, ["t9", "z"])])
    cases.append([(k, ["hot"] if k % 3 == 0 else [f"own{k}"]) for k in range(300)])
    cases.append([(0, ["a"]), (1, ["b"]), (2, ["a", "b"]), (3, ["b"]), (4, ["c"]), (5, ["c", "b"])])
    return cases


@pytest.mark.parametrize(("bits", "scanned"), [(12, 1 << 15), (12, 60), (1, 0)])
def test_clusters_are_those_of_the_row_loop(spark, monkeypatch, bits, scanned):
    """In order, by steps, and some groups in either way."""
    monkeypatch.setattr(cluster, "SPAN_BITS", bits)
    monkeypatch.setattr(cluster, "SCANNED", scanned)
    cases = grouped_cases()
    rows = [(None if g == 3 else f"g{g}", pos, t, "clash") for g, case in enumerate(cases) for pos, t in case]
    out = cluster.greedy_clusters(spark.createDataFrame(rows, "grp string, pos long, tokens array<string>, c string").repartition(7), "grp", "pos", "tokens")
    assert out.dtypes == [("grp", "string"), ("pos", "bigint"), ("cluster", "bigint"), ("place", "bigint")]
    got = {}
    for r in out.collect():
        got.setdefault(r.grp, []).append((r.pos, r.cluster, r.place))
    for g, case in enumerate(cases):
        want = clusters(case)
        order = {p: k for k, (_, p) in enumerate(sorted((c, p) for p, c in want))}
        assert sorted(got[None if g == 3 else f"g{g}"]) == [(p, c, order[p]) for p, c in want], g


def chunks(tokens, size):
    n, total = -(-len(tokens) // size), sum(x or 0 for x in tokens)
    out, chunk, held = [], 1, 0
    for k, x in enumerate(tokens):
        held += x or 0
        out.append(chunk)
        if chunk < n and held * n >= total and len(tokens) - k - 1 >= n - chunk:
            chunk, held = chunk + 1, 0
    return out


@pytest.mark.parametrize("folded", [4096, 40, 0])
def test_chunks_are_those_of_the_row_loop(spark, monkeypatch, folded):
    monkeypatch.setattr(cluster, "FOLDED", folded)
    rng = random.Random(11)
    cases = [[rng.choice([1, 1, 2, 5, 40]) for _ in range(rng.randint(1, 60))] for _ in range(40)]
    cases += [[0] * 23, [None, 0, 7, 0, 0], [1000, *[1] * 40], [*[1] * 40, 1000], [3] * 700, [0, 0, 5, 0, 0, 0, 9, 0, 0, 1]]
    rows = [(None if g == 2 else g, 10 * k - 50, x) for g, case in enumerate(cases) for k, x in enumerate(case)]
    out = cluster.balanced_chunks(spark.createDataFrame(rows, "grp int, pos long, tokens int").repartition(5), "grp", "pos", "tokens", 4)
    assert out.dtypes == [("grp", "int"), ("pos", "bigint"), ("chunk", "int")]
    got = {}
    for r in sorted(out.collect(), key=lambda r: r.pos):
        got.setdefault(r.grp, []).append(r.chunk)
    for g, case in enumerate(cases):
        assert got[None if g == 2 else g] == chunks(case, 4), g


@pytest.mark.parametrize("folded", [4096, 30, 0])
def test_cooldowns_are_those_of_the_row_loop(spark, monkeypatch, folded):
    monkeypatch.setattr(state, "FOLDED", folded)
    rng = random.Random(4)
    cases = [[rng.randint(0, 9000) for _ in range(rng.randint(1, 60))] for _ in range(40)] + [[60 * k for k in range(500)], [5] * 20, [0, 600, 601, 1200, 1201, 1202]]
    rows = [(None if g == 1 else f"g{g}", t, 100 * g + k, "x") for g, case in enumerate(cases) for k, t in enumerate(case)]
    got = state.greedy_cooldown(spark.createDataFrame(rows, "grp string, t long, id long, at string").repartition(5), ["grp"], "t", "id", 10)
    want = []
    for g, case in enumerate(cases):
        until = None
        for t, k in sorted((t, k) for k, t in enumerate(case)):
            if until is None or t > until:
                until = t + 600
                want.append((None if g == 1 else f"g{g}", 100 * g + k))
    assert sorted(((r.grp, r.id) for r in got.collect()), key=str) == sorted(want, key=str)


def test_empty_frames(spark):
    assert cluster.greedy_clusters(spark.createDataFrame([], "grp string, pos long, tokens array<string>"), "grp", "pos", "tokens").count() == 0
    assert cluster.balanced_chunks(spark.createDataFrame([], "grp int, pos long, tokens int"), "grp", "pos", "tokens", 4).count() == 0


def test_sums_places_and_next_values_cross_parts(spark):
    """A group of 3,000 rows over seven parts, beside small ones and one without a name."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        df = spark.range(3030).select(F.when(F.col("id") < 3000, "hot").when(F.col("id") < 3020, F.concat(F.lit("g"), F.col("id") % 3)).alias("grp"), F.col("id").alias("pos"), F.when(F.col("id") % 500 == 7, F.col("id")).alias("mark"))
        laid = ordered.laid_out(df, ["grp"], ["pos"])
        assert laid.where("grp = 'hot'").select("part").distinct().count() > 3
        rows = ordered.running(laid, ["grp"], {"upto": F.col("pos")}).collect()
        nexts = {r.pos: r.nxt for r in ordered.next_value(laid, ["grp"], "mark", "nxt").collect()}
        seats = {r.pos: r.place for r in ordered.places(df, ["grp"], ["pos"], "place").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    by = {}
    for r in rows:
        by.setdefault(r.grp, []).append(r)
    for own in by.values():
        total, marks = 0, sorted(r.mark for r in own if r.mark is not None)
        for k, r in enumerate(sorted(own, key=lambda r: r.pos)):
            total += r.pos
            assert (r.upto, seats[r.pos], nexts[r.pos]) == (total, k, next((m for m in marks if m >= r.pos), None))


def test_next_values_take_no_frame_that_shrinks(spark):
    """Spark computes a frame up to the group's end anew for each row, a part's rows squared."""
    laid = spark.range(10).select(F.lit("g").alias("grp"), "id", F.col("id").alias("seat"), F.lit(0).alias("part"))
    plan = ordered.next_value(laid, ["grp"], "id", "next")._jdf.queryExecution().analyzed().toString().lower()
    assert "windowspecdefinition" in plan and "unboundedfollowing" not in plan


def test_groups_of_many_tokens_are_clustered_by_steps(spark, monkeypatch):
    monkeypatch.setattr(cluster, "SCANNED_TOKENS", 100)
    taken = []
    by_steps = cluster.clusters_by_steps
    monkeypatch.setattr(cluster, "clusters_by_steps", lambda items, *names: taken.extend(r.grp for r in items.select("grp").distinct().collect()) or by_steps(items, *names))
    cases = [[(k, [f"t{j}" for j in range(k, k + 3)]) for k in range(60)], [(k, [f"u{k}", f"u{k % 5}"]) for k in range(20)]]
    df = spark.createDataFrame([(f"g{g}", pos, t) for g, case in enumerate(cases) for pos, t in case], "grp string, pos long, tokens array<string>")
    got = cluster.greedy_clusters(df, "grp", "pos", "tokens").collect()
    assert taken == ["g0"]
    for g, case in enumerate(cases):
        assert sorted((r.pos, r.cluster) for r in got if r.grp == f"g{g}") == sorted(clusters(case))

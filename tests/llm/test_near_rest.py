"""Links of long runs between ids that no hub joins."""

from __future__ import annotations

import random
import string

import pytest

from daybreak.llm import line_dedup, near


@pytest.mark.parametrize(("tile", "few"), [(1024, 4), (8, 0)])
def test_a_link_beside_every_hub_is_found(spark, monkeypatch, tile, few):
    monkeypatch.setattr(near, "TILE", tile)
    monkeypatch.setattr(near, "FEW", few)
    line_dedup.ship(spark)
    rng = random.Random(3)
    lines = ["".join(rng.choices(string.ascii_lowercase, k=80)) for _ in range(40)]
    lines[35] = lines[30][:-2] + "##"
    lines[38] = lines[36][:-2] + "##"
    lines[39] = "##" + lines[36][2:]
    runs = [(near.RUN, 1, k, 40, 0) for k in range(40)] + [(near.RUN, 2, k, 20, 0) for k in range(20)]
    bodies = spark.createDataFrame(list(enumerate(lines)), "id long, line string")

    def sets(column):
        return line_dedup.line_sets(column, 5)

    def confirm(pairs):
        both = pairs.join(bodies.toDF("a", "ta"), "a").join(bodies.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
        return both.mapInArrow(near.similar(sets, 80), "a long, b long")

    def marks(ids):
        return bodies.join(ids, "id").select("id", "line").mapInArrow(near.marked(sets, 1024), "id long, size long, mark binary")

    roots = near.linked(near.Candidates(spark.createDataFrame(runs, near.FOUND)), confirm, near.Rest(marks, 80))
    assert sorted(tuple(r) for r in roots.collect()) == [(35, 30), (38, 36), (39, 36)]

"""Distributed union-find over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybreak.llm.common import remove, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node that isn't the smallest of its component; edges are (a, b).

    Each round hooks every node to its smallest smaller neighbour, compresses the resulting trees by
    pointer jumping, and goes on with the edges between different roots, which are far fewer. Every
    table between rounds is written to the shared folder, so a lost executor costs one step.
    """
    links = stored(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "links")
    roots: DataFrame | None = None
    while not links.isEmpty():
        parent = stored(links.groupBy("hi").agg(F.min("lo").alias("root"), F.lit(True).alias("moved")), "parents")
        while True:
            above = parent.select(F.col("hi").alias("root"), F.col("root").alias("next"))
            jumped = stored(parent.join(above, "root", "left").select("hi", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "jumps")
            remove(parent)
            parent = jumped
            if jumped.where("moved").isEmpty():
                break
        risen = parent.select(F.col("hi").alias("id"), "root")
        if roots is not None:
            step = parent.select(F.col("hi").alias("root"), F.col("root").alias("next"))
            moved = roots.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
            risen = stored(moved.unionByName(risen.join(roots.select("id"), "id", "left_anti")), "roots")
        low = parent.select(F.col("hi").alias("lo"), F.col("root").alias("lo_root"))
        ends = links.join(parent.select("hi", "root"), "hi").join(low, "lo", "left").select("root", F.coalesce("lo_root", "lo").alias("other"))
        left = stored(ends.where("root <> other").select(F.greatest("root", "other").alias("hi"), F.least("root", "other").alias("lo")).distinct(), "links")
        remove(links, *([] if roots is None else [roots, parent]))
        if roots is None:
            risen._daybreak_path = parent._daybreak_path  # the first round's trees are its roots
        roots, links = risen, left
    if roots is None:
        return links.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
    remove(links)
    return roots

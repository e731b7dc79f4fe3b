"""Prompts and summaries: what of the items a prompt gets, in which parts, and how the parts come together, level by level."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybreak.functions import category
from daybreak.functions.text import link_urls, resolved_title, truncate
from daybreak.operators.cluster import balanced_chunks, greedy_clusters, signature, text_weight, token_estimate
from daybreak.operators.dedupe import heaviest_wins
from daybreak.render import extractive_summary, merge_prompt, prompt, repair_prompt
from daybreak.session import ship
from daybreak.tables import remove, stored

#: Items that a prompt gets at most.
MOST_ITEMS = 50


def compact_items(items: DataFrame, group: str, pos: str, most: int = MOST_ITEMS) -> DataFrame:
    """The first `most` items of each group with a resolved title, shortened texts and their times, beside the counts of all, included and omitted ones.

    fetched and synthesised titles are columns of the items where there are any.
    """
    given = lambda name: F.col(name) if name in items.columns else F.lit(None).cast("string")
    counts = items.groupBy(group).agg(F.count("*").alias("total_items"))
    counts = counts.withColumns({"included_in_prompt": F.least("total_items", F.lit(most).cast("long")), "omitted_from_prompt": F.greatest(F.col("total_items") - most, F.lit(0).cast("long"))})
    place = F.row_number().over(Window.partitionBy(group).orderBy(pos))
    first = items.withColumn("prompt_place", place).where(F.col("prompt_place") <= most).drop("prompt_place")
    title = resolved_title(given("title"), given("fetched_title"), given("synthesised_title"), given("url"), given("excerpt"), given("body"))
    out = first.select(group, pos, title.alias("title"), truncate(given("excerpt"), 280).alias("excerpt"), truncate(given("body"), 280).alias("body"), given("url").alias("url"), *(given(c).alias(c) for c in ("created_at", "updated_at", "start_at", "end_at")))
    return out.join(counts, group)


def prompt_parts(items: DataFrame, size: int = MOST_ITEMS) -> DataFrame:
    """(category, chunk, pos, title, url, body) of items (pos, source, kind, title, body, url): the heaviest of each address, by category, near items together, in parts of about equal length."""
    once = heaviest_wins(items, "url", text_weight(F.col("title"), F.col("body")), "pos").drop("keyed", "first_pos")
    named = once.withColumn("category", category.classify(category.haystack(*map(F.col, ("source", "kind", "title", "body", "url")))))
    clusters = greedy_clusters(named.withColumn("tokens", signature(F.col("title"), F.col("body"), url=F.col("url"))), "category", "pos", "tokens")
    placed = named.join(clusters, ["category", "pos"]).withColumn("tokens", token_estimate(F.col("title"), F.col("body")))
    return placed.join(balanced_chunks(placed, "category", "place", "tokens", size), ["category", "place"]).select("category", "chunk", "place", "pos", "title", "url", "body")


#: Summaries that one prompt merges.
FAN = 8
NODE = "category string, node long, urls array<string>, text string, calls int"


def summarise(items: DataFrame, run: Callable[[str], str] = extractive_summary, size: int = MOST_ITEMS, fan: int = FAN) -> dict[str, str]:
    """A summary of each category, in the order of categories."""
    rows = summary_tree(items, run, size, fan).collect()  # one row a category
    made = {r.category: r.text for r in rows}
    return {c: made[c] for c in category.ORDER if c in made}


def summary_tree(items: DataFrame, run: Callable[[str], str] = extractive_summary, size: int = MOST_ITEMS, fan: int = FAN) -> DataFrame:
    """(category, node, urls, text, calls): one summary of each category, made level by level.

    The lowest level has a node for each part of a category, the next ones merge up to `fan` nodes, until a category has one. A level is
    one plan whose nodes call `run` in their tasks, and is written before the next one. A node that has lost every
    link of its own is asked for once more, with the links; if they are still missing, its items' lines or the texts it
    was to merge stand for it. calls counts the requests below a node, its own included.
    """
    parts = prompt_parts(items, size)
    line = F.struct("place", F.concat(F.lit("- "), F.when(F.col("url").isNotNull(), F.concat(F.lit("["), F.coalesce("title", F.lit("Untitled")), F.lit("]("), "url", F.lit(")"))).otherwise(F.coalesce("title", F.lit("Untitled")))).alias("line"), "url")
    leaves = parts.groupBy("category", "chunk").agg(F.array_sort(F.collect_list(line)).alias("rows"))  # as many as a prompt holds
    counts = parts.groupBy("category").agg(F.max("chunk").alias("parts"))
    leaves = leaves.join(counts, "category").select("category", (F.col("chunk") - 1).cast("long").alias("node"), "parts", F.col("rows.line").alias("texts"), F.filter("rows.url", lambda u: u.isNotNull()).alias("urls"), F.lit(0).alias("calls"))
    level = stored(_asked(leaves, run, False), "summaries")
    while not level.where("node > 0").isEmpty():
        several = F.struct("node", "text", "urls", "calls")
        groups = level.groupBy("category", F.floor(F.col("node") / fan).cast("long").alias("up")).agg(F.array_sort(F.collect_list(several)).alias("rows"))
        merged = groups.select("category", F.col("up").alias("node"), F.size("rows").alias("parts"), F.col("rows.text").alias("texts"), F.array_distinct(F.flatten("rows.urls")).alias("urls"), F.aggregate("rows.calls", F.lit(0), lambda a, x: a + x).alias("calls"))
        above = stored(_asked(merged, run, True), "summaries")
        remove(level)
        level = above
    return level


def _asked(nodes: DataFrame, run: Callable[[str], str], merging: bool) -> DataFrame:
    """NODE rows of (category, node, parts, texts, urls, calls), a request each at least; a node of one text to merge keeps it."""
    ship(nodes.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made, calls = row["texts"][0] if merging else "", row["calls"]
                if not merging or len(row["texts"]) > 1:
                    asked = merge_prompt(row["category"], row["texts"]) if merging else prompt(row["category"], row["node"] + 1, row["parts"], row["texts"])
                    made, again = _checked(run, asked, row["urls"], row["texts"])
                    calls += 1 + again
                values = (row["category"], row["node"], row["urls"], made, calls)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int32()))], ["category", "node", "urls", "text", "calls"])

    return nodes.repartition("category", "node").mapInArrow(ask, NODE)


def _checked(run: Callable[[str], str], asked: str, wanted: list[str], fallback: list[str]) -> tuple[str, bool]:
    """What was made, with a link of those wanted if there are any, and whether it was asked for twice."""
    made = run(asked)
    if not wanted or any(u in made for u in wanted):
        return made, False
    made = run(repair_prompt(asked, made, wanted))
    return (made if any(u in made for u in wanted) else "\n".join(fallback)), True


def missing_links(summaries: DataFrame) -> DataFrame:
    """(id, urls) of summaries (id, text, expected) that hold none of the expected addresses."""
    return summaries.where((F.size("expected") > 0) & ~F.arrays_overlap("expected", link_urls(F.col("text")))).select("id", F.col("expected").alias("urls"))


def notice(errors: DataFrame, group: str) -> DataFrame:
    """(group, n, notice): the errors of each group's sources, a line each, by source."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("source", "error"))), lambda e: F.concat(e.source, F.lit(": "), e.error))
    return errors.groupBy(group).agg(F.count("*").cast("int").alias("n"), F.array_join(lines, "\n").alias("notice"))


def with_notice(digest: str, errors: Mapping[str, str], fallback: bool = False) -> str:
    """A digest behind a notice of its sources' errors, by source, and of a history that came from a browser."""
    told = [f"- {source}: {error}" for source, error in sorted(errors.items())]
    head = ["> Some sources failed:", *told, ""] if told else []
    head += ["> Conversations came from the browser's history.", ""] if fallback else []
    return "\n".join([*head, digest])

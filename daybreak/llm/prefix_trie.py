"""The trie of all conversation prefixes, with what each subtree would save if its prefixes were stored once.

A node is a distinct sequence of first turns (role, text). It is named by a digest: 128 bits of hashes of each
turn's SHA-256 and place, summed up to the node's depth, so that names come from running sums and the same turns in another order
have another name. Numbering and running sums cut a conversation into parts of bounded size, so one of any length is
spread over tasks. Every node knows its parent's name; leaf counts and savings then rise by pointer
jumping: in round k each node adds its sums to the ancestor 2^k above it and takes over that ancestor's pointer, so
a trie of depth D takes log2(D) rounds, each a few joins on names and an aggregation with map-side sums. Pointers past the root
are dropped, so nodes without one gather nowhere. The digest of the members that end in a node is SHA-256
over their ids in order, sequential by definition: ids travel in packed blocks and stream through a hash.

Cases: a null role or text is empty; null turns come first and turns of equal number are in the order of their SHA-256;
equal rows are as many turns; rows without conv_id take no part; an empty table has no node, not even a root; a
conversation whose turns are all replaced by those of an absent one ends in the root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybreak.llm.common import remove, ship, stored, table

#: Rows that a running sum takes into one window, and conversation ids that go into one block of a digest.
CHUNK_BITS = 10
BLOCK_BITS = 12
LANES = ("lane_0", "lane_1", "lane_2", "lane_3")


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, digest, bytes, seat) in the order of turns: seats ascend within a part, their upper bits are the part."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("tie"),
    )
    order = ["conv_id", "turn", "digest", "tie"]
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "bytes", F.monotonically_increasing_id().alias("seat")), "turns")


def heads_kept(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first one of its group of five."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, length, digest, bytes) of every rebuilt conversation's turns from place 1, and (conv_id, length)."""
    part = F.shiftright("seat", 33)
    by_part = Window.partitionBy("conv_id").orderBy("part")
    spans = turns.groupBy("conv_id", part.alias("part")).agg(F.count("*").alias("n"), F.min("seat").alias("first"))
    spans = spans.withColumns({"before": F.sum("n").over(by_part) - F.col("n"), "own": F.sum("n").over(Window.partitionBy("conv_id"))})
    spans = stored(spans.withColumn("h", heads_kept(F.col("conv_id"))), "spans")
    whole = spans.where("before = 0").select("conv_id", "own", "h", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    found = whole.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    kept = F.least("h", F.coalesce("there", F.lit(0)))
    convs = stored(whole.join(found, "base", "left").select("conv_id", kept.alias("kept"), (kept + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "convs")
    at = F.col("seat") - F.col("first") + F.col("before") + 1
    own = turns.withColumn("part", part).join(spans.join(convs, "conv_id"), ["conv_id", "part"]).where(at > F.col("h"))
    own = own.select("conv_id", (at - F.col("h") + F.col("kept")).alias("place"), "length", "digest", "bytes")
    lent = turns.where("conv_id % 5 = 0").withColumn("part", part).join(spans.where("before < 8 AND conv_id % 5 = 0"), ["conv_id", "part"]).where(at <= 8)
    lent = lent.select(F.col("conv_id").alias("base"), at.alias("place"), "digest", "bytes", F.explode(F.sequence(F.col("conv_id") - 4, F.col("conv_id") + 4)).alias("conv_id"))
    lent = lent.where("conv_id - conv_id % 5 = base").where(F.col("place") <= heads_kept(F.col("conv_id")))
    return own.unionByName(lent.join(convs, "conv_id").select(*own.columns)), convs


def running_sums(rows: DataFrame, key: str, place: str, values: tuple[str, ...], longest: int) -> DataFrame:
    """The values summed up to each place of a key; places are gapless from 0 to `longest` at most.

    Windows hold 2^CHUNK_BITS rows; the sums of whole windows are summed up in the same way.
    """
    chunk = F.shiftright(place, CHUNK_BITS)
    window = Window.partitionBy(key, "chunk").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = rows.withColumn("chunk", chunk).withColumns({v: F.sum(v).over(window) for v in values})
    if longest >> CHUNK_BITS:
        totals = rows.groupBy(key, chunk.alias(place)).agg(*(F.sum(v).alias(v) for v in values))
        before = running_sums(totals, key, place, values, longest >> CHUNK_BITS).select(key, (F.col(place) + 1).alias("chunk"), *(F.col(v).alias(f"{v}_before") for v in values))
        inner = inner.join(before, [key, "chunk"], "left").withColumns({v: F.col(v) + F.coalesce(f"{v}_before", F.lit(0)) for v in values})
    return inner.select(*rows.columns)


def named_paths(rows: DataFrame, convs: DataFrame, longest: int) -> DataFrame:
    """(conv_id, depth, node, parent, bytes, is_end) of every prefix of every rebuilt conversation, the root's without a parent."""
    halves = [half for j in range(2) for x in (F.xxhash64("digest", "place", F.lit(j)),) for half in (F.shiftright(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF)))]
    turns = rows.select("conv_id", "place", "length", "bytes", *(F.when(F.col("digest").isNull(), 0).otherwise(x).cast("long").alias(c) for c, x in zip(LANES, halves)))
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("place"), "length", F.lit(0).cast("long").alias("bytes"), *(F.lit(0).cast("long").alias(c) for c in LANES))
    own = turns.unionByName(roots).withColumns({f"{c}_own": F.col(c) for c in LANES})
    sums = running_sums(own, "conv_id", "place", LANES, longest)

    def name(depth: Column, lanes: list[Column]) -> Column:
        return F.unhex(F.md5(F.concat_ws(",", depth, *lanes).cast("binary")))

    above = name(F.col("place") - 1, [F.col(c) - F.col(f"{c}_own") for c in LANES])
    return sums.select("conv_id", F.col("place").alias("depth"), name(F.col("place"), [F.col(c) for c in LANES]).alias("node"), F.when(F.col("place") > 0, above).alias("parent"), "bytes", (F.col("place") == F.col("length")).alias("is_end"))


def rollup(nodes: DataFrame, values: tuple[str, ...], deepest: int) -> DataFrame:
    """The values of (node, parent, ...) summed over every node's subtree, itself included."""
    sums = nodes.select("node", *values)
    pointers = nodes.where(F.col("parent").isNotNull()).select("node", F.col("parent").alias("up"))
    reach, spent = 1, []
    while reach <= deepest:
        risen = pointers.join(sums, "node").groupBy(F.col("up").alias("node")).agg(*(F.sum(v).alias(f"{v}_below") for v in values))
        nexts = stored(sums.join(risen, "node", "left").select("node", *((F.col(v) + F.coalesce(f"{v}_below", F.lit(0))).alias(v) for v in values)), "sums")
        reach *= 2
        jumped = stored(pointers.join(pointers.select(F.col("node").alias("up"), F.col("up").alias("over")), "up").select("node", F.col("over").alias("up")), "pointers") if reach <= deepest else None
        remove(*spent)
        spent = [x for x in (nexts, jumped) if x is not None]
        sums, pointers = nexts, jumped
    return sums


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): SHA-256 of the decimal ids in ascending order, joined by commas."""
    blocks = ends.groupBy("node", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            out = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node == held:
                    state.update(b"," + ids.encode())
                    continue
                if held is not None:
                    out.append((held, state.hexdigest()))
                held, state = node, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["node", "ends_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "ends_sha256"])

    ordered = blocks.repartition("node").sortWithinPartitions("node", "block").select("node", "ids")
    return ordered.mapInArrow(hashed, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: its smallest member, depth, parent, members, children, and sums over its subtree."""
    ship(conversations.sparkSession)
    turns = numbered(conversations)
    rows, convs = rebuilt(turns)
    longest = convs.agg(F.max("length")).first()[0] or 0
    paths = stored(named_paths(rows, convs, longest), "paths")
    grouped = paths.groupBy("node", "parent", "depth", "bytes").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes = stored(grouped, "nodes")
    remove(turns)
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, "node", "left").select(*nodes.columns, F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children")), "nodes")
    own = nodes.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    sums = rollup(own, ("n_leaves", "saved_tokens"), longest)
    ends = ends_digests(paths.where("is_end").select("node", "conv_id"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "node").join(ends, "node", "left").join(above, "parent", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, x: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1))) AS steps
),
t AS (
  SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS turn,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL
),
c AS (SELECT conv_id, list(turn ORDER BY k) AS turns FROM t GROUP BY conv_id),
h AS (
  SELECT c.*, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
    lambda s, x: xor(s >> 8, steps[(xor(s, x) & 255) + 1])), 4294967295) % 9 AS h
  FROM c, crc
),
l AS (
  SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns
  FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 5
),
p AS (SELECT conv_id, d AS depth, turns[1:d] AS path, d = len(turns) AS is_end FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM l)),
n AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM p GROUP BY path, depth
),
k AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth > 0 THEN (n_convs - 1) * strlen(n.path[n.depth].t) ELSE 0 END AS saved
  FROM n LEFT JOIN k ON k.path = n.path AND k.depth = n.depth
),
u AS (
  SELECT path[1:d] AS path, d AS depth, sum(n_children = 0)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM f) GROUP BY 1, 2
)
SELECT f.conv_id, f.depth, a.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN u ON u.path = f.path AND u.depth = f.depth
LEFT JOIN n a ON a.path = f.path[1:f.depth - 1] AND a.depth = f.depth - 1
"""

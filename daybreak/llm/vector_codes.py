"""Product codes of vectors: a codebook for each part position, fitted by filtering Lloyd iterations.

Components become integers, floor(scale * x), and vectors are cut into equal consecutive parts. Every partition
builds a kd-tree over its parts at each position, in chunks of bounded bytes, with the box, the sum and the number of the points
of every node; the trees are written to the shared folder once and serve every round. A round walks each tree
from its root with the codebook's entries as candidates: of those the one nearest to the box's middle drops all that
are nowhere in the box nearer than it, and where one is left, the whole subtree is assigned by its cached sum. Only points of leaves with
several candidates are compared one by one. A task sends the sums of its points by entry, at most as many rows as
the codebooks have components; these are also all that the driver ever sees. Arithmetic is on integers (or on doubles where these hold
every intermediate value exactly), so results don't depend on how rows are dealt.

Cases: vectors that are null or hold null or non-finite components take no part; vectors shorter than the
longest one, rounded up to a multiple of the number of parts, count as filled up with zeros; entries start from the rows of smallest
id, rows of equal id in the order of their vectors, null ids last; fewer rows than entries give fewer entries; of
equally near entries the lower one wins; an entry without points stays; rows may repeat; an empty table gives no
rows; other columns are ignored. Components so large that squared distances could leave 63 bits are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybreak.llm.common import remove, ship, stored, table

#: Points of a leaf at most, and bytes of the parts of a chunk.
LEAF = 16
CHUNK_BYTES = 4 << 20


class Forest(NamedTuple):
    """The trees of a chunk, one for each part position; node arrays hold a tree's levels one after the other."""

    points: np.ndarray  # (parts, n, width), in the order of the tree
    order: np.ndarray  # (parts, n): the row of each point
    low: np.ndarray  # (parts, nodes, width)
    high: np.ndarray
    sums: np.ndarray

    def blobs(self) -> list[bytes]:
        return [x.tobytes() for x in self]


def depth_of(n: int) -> int:
    """Levels below the root, so that leaves have LEAF points at most."""
    return max(0, (-(-n // LEAF) - 1).bit_length())


def bounds_at(n: int, level: int) -> np.ndarray:
    return (np.arange((1 << level) + 1) * n) >> level


def grow(rows: np.ndarray, parts: int) -> Forest:
    """Trees over (n, parts * width) integers; every node splits at the median of its widest side."""
    n, width = len(rows), rows.shape[1] // parts
    depth = depth_of(n)
    made = []
    for at in range(parts):
        points, order = rows[:, at * width : (at + 1) * width], np.arange(n)
        for level in range(depth):
            bounds = bounds_at(n, level)
            here = points[order]
            side = (np.maximum.reduceat(here, bounds[:-1]) - np.minimum.reduceat(here, bounds[:-1])).argmax(axis=1)
            node = np.repeat(np.arange(1 << level), np.diff(bounds))
            order = order[np.lexsort((here[np.arange(n), side[node]], node))]
        here, first = points[order], bounds_at(n, depth)[:-1]
        levels = [(np.minimum.reduceat(here, first), np.maximum.reduceat(here, first), np.add.reduceat(here.astype(np.int64), first))]
        for _ in range(depth):
            low, high, sums = levels[0]
            levels.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), sums[::2] + sums[1::2]))
        made.append((here, order.astype(np.int32), *(np.concatenate(x) for x in zip(*levels))))
    return Forest(*(np.stack(x) for x in zip(*made)))


def planted(n: int, parts: int, width: int, blobs: list) -> Forest:
    """The forest that blobs() wrote."""
    nodes = (2 << depth_of(n)) - 1
    shapes = [(np.int32, (parts, n, width)), (np.int32, (parts, n)), (np.int32, (parts, nodes, width)), (np.int32, (parts, nodes, width)), (np.int64, (parts, nodes, width))]
    return Forest(*(np.frombuffer(b, t).reshape(s) for b, (t, s) in zip(blobs, shapes)))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


def kind_for(largest: int, width: int) -> type:
    """The type in which all intermediate values of a walk are exact."""
    reach = 16 * width * largest * largest
    if reach >= 1 << 62:
        raise ArithmeticError(f"components up to {largest} are too large for distances of 63 bits")
    return np.float64 if reach < 1 << 52 else np.int64


def walk(forest: Forest, at: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each point in the order of the tree, sums and numbers of points by entry) at a part position."""
    points, n, width = forest.points[at], forest.points.shape[1], forest.points.shape[2]
    kind = kind_for(int(max(np.abs(entries).max(), np.abs(forest.low[at, 0].astype(np.int64)).max(), np.abs(forest.high[at, 0].astype(np.int64)).max())), width)
    z = entries.astype(kind)
    zz, apart, names = (z * z).sum(axis=1), np.abs(z[:, None] - z[None]), np.arange(len(z))
    codes, sums, counts = np.empty(n, np.int64), np.zeros((len(z), width), np.int64), np.zeros(len(z), np.int64)
    nodes, alive = np.zeros(1, np.int64), np.ones((1, len(z)), bool)
    depth = depth_of(n)
    for level in range(depth + 1):
        stored_at = nodes + (1 << level) - 1
        low, high = forest.low[at, stored_at].astype(kind), forest.high[at, stored_at].astype(kind)
        along = (low + high) @ z.T
        far = np.iinfo(np.int64).max if kind is np.int64 else np.inf
        best = np.where(alive, zz - along, far).argmin(axis=1)  # nearest to the middle of the box
        # twice the least lead of the best one over each other within the box
        lead = zz - zz[best][:, None] - (along - along[np.arange(len(best)), best][:, None]) - np.einsum("mw,mkw->mk", high - low, apart[best])
        alive &= ~((lead > 0) | ((lead == 0) & (names > best[:, None])))
        alone = alive.sum(axis=1) == 1
        bounds = bounds_at(n, level)
        starts, lengths = bounds[nodes], bounds[nodes + 1] - bounds[nodes]
        codes[_ranges(starts[alone], lengths[alone])] = np.repeat(best[alone], lengths[alone])
        np.add.at(sums, best[alone], forest.sums[at, stored_at[alone]])
        np.add.at(counts, best[alone], lengths[alone])
        nodes, alive = nodes[~alone], alive[~alone]
        if level < depth:
            nodes, alive = np.repeat(2 * nodes, 2) + np.tile([0, 1], len(nodes)), np.repeat(alive, 2, axis=0)
    bounds = bounds_at(n, depth)
    few_first = np.argsort(alive.sum(axis=1), kind="stable")
    for some in np.array_split(few_first, -(-len(few_first) // 128)) if len(few_first) else []:
        living = alive[some]
        most = int(living.sum(axis=1).max())
        choices = np.argsort(~living, axis=1, kind="stable")[:, :most]  # in ascending order of entries
        starts, lengths = bounds[nodes[some]], bounds[nodes[some] + 1] - bounds[nodes[some]]
        places, of = _ranges(starts, lengths), np.repeat(np.arange(len(some)), lengths)
        near = zz[choices][of] - 2 * np.einsum("pw,pcw->pc", points[places].astype(kind), z[choices][of])
        near[~np.take_along_axis(living, choices, axis=1)[of]] = np.inf if kind is np.float64 else np.iinfo(np.int64).max
        found = choices[of, near.argmin(axis=1)]
        codes[places] = found
        np.add.at(sums, found, points[places].astype(np.int64))
        np.add.at(counts, found, 1)
    return codes, sums, counts


def integers(column: pa.Array, length: int, scale: int) -> np.ndarray:
    """(rows, length) of floor(scale * x), shorter vectors filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    scaled = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False))
    if len(scaled) and np.abs(scaled).max() >= 1 << 31:
        raise ArithmeticError("a component has more than 31 bits")
    out = np.zeros((len(column), length), np.int32)
    out[np.repeat(np.arange(len(column)), sizes), _ranges(np.zeros(len(sizes), np.int64), sizes)] = scaled
    return out


class Coded(NamedTuple):
    codes: DataFrame  # id, label, code, error
    codebooks: np.ndarray  # (parts, entries, width)


def product_codes(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Coded:
    """The code of every vector, two hex digits a part, with its squared distance from what the code stands for."""
    spark = vectors.sparkSession
    ship(spark)
    label_type = vectors.schema[label_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vector").isNotNull() & finite)
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    length = parts * width
    chunk_rows = max(LEAF, CHUNK_BYTES // (4 * length))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def chunk(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            ids, labels, found = (pa.concat_arrays([b.column(k) for b in some]) for k in range(3))
            ends = pa.array([0, len(ids)], pa.int32())
            blobs = grow(integers(found, length, scale), parts).blobs()
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, labels), *(pa.array([b], pa.binary()) for b in blobs)], names)

        for batch in batches:
            while batch.num_rows:
                more = batch.slice(0, chunk_rows - sum(b.num_rows for b in held))
                held.append(more)
                batch = batch.slice(more.num_rows)
                if sum(b.num_rows for b in held) == chunk_rows:
                    yield chunk(held)
                    held = []
        if held:
            yield chunk(held)

    names = ["ids", "labels", *Forest._fields]
    schema = f"ids array<long>, labels array<{label_type}>, {', '.join(f'{x} binary' for x in Forest._fields)}"
    trees = stored(rows.mapInArrow(plant, schema), "trees")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow().column(0).combine_chunks()
    books = integers(first, length, scale).astype(np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    for _ in range(rounds if len(first) else 0):
        books = _moved(trees, books)

    sent = spark.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for ids, labels, forest in _forests(batch, known):
                out, error = np.empty((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for at in range(parts):
                    found, _, _ = walk(forest, at, known[at])
                    out[forest.order[at], at] = found
                    error[forest.order[at]] += ((forest.points[at] - known[at][found]) ** 2).sum(axis=1)
                text = out.tobytes().hex()
                step = 2 * parts
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([text[k : k + step] for k in range(0, len(text), step)]), pa.array(error)], ["id", "label", "code", "error"])

    codes = stored(trees.mapInArrow(code, f"id long, label {label_type}, code string, error long"), "codes")
    remove(trees)
    return Coded(codes, books)


def _forests(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array, Forest]]:
    for row in range(batch.num_rows):
        ids, labels = batch.column(0)[row].values, batch.column(1)[row].values
        yield ids, labels, planted(len(ids), books.shape[0], books.shape[2], [batch.column(k)[row].as_buffer() for k in range(2, 7)])


def _moved(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry at the floor of the mean of its points; one without points stays."""
    sent = trees.sparkSession.sparkContext.broadcast(books)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        sums = np.zeros((*known.shape[:2], known.shape[2] + 1), np.int64)  # the last place counts
        for batch in batches:
            for _, _, forest in _forests(batch, known):
                for at in range(len(known)):
                    _, total, count = walk(forest, at, known[at])
                    sums[at, :, :-1] += total
                    sums[at, :, -1] += count
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums.ravel()[used])], ["place", "total"])

    total = F.sum(F.col("total").cast("decimal(38,0)"))
    found = trees.mapInArrow(gather, "place long, total long").groupBy("place").agg(total.alias("total")).collect()
    sums = {r.place: int(r.total) for r in found}
    step = books.shape[2] + 1
    out = books.copy()
    for entry in range(books.shape[0] * books.shape[1]):
        if count := sums.get(entry * step + step - 1, 0):
            out[entry // books.shape[1], entry % books.shape[1]] = [sums.get(entry * step + k, 0) // count for k in range(step - 1)]
    return out


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = product_codes(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, coded.codebooks.ravel().tolist())).encode()).hexdigest()
    by_label = coded.codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.codes.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """Two rounds and the last assignment, in blocks of parts against entries."""
    nearest = """
a{n} AS (
  SELECT vec_id, label, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT x.vec_id, x.label, x.p, b.e, list_sum(list_transform(range(1, w + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))::BIGINT AS d
    FROM x JOIN b{n} b USING (p), wide
  ) GROUP BY vec_id, label, p
)"""
    moved = """
b{m} AS (
  SELECT b.p, b.e, coalesce(s.v, b.v) AS v FROM b{n} b LEFT JOIN (
    SELECT p, e, list(c ORDER BY i) AS v FROM (
      SELECT p, e, i, (sum(k) - ((sum(k) % count(*)) + count(*)) % count(*)) // count(*) AS c
      FROM (SELECT a.p, a.e, unnest(range(1, w + 1)) AS i, unnest(x.v) AS k FROM a{n} a JOIN x USING (vec_id, p), wide) GROUP BY p, e, i
    ) GROUP BY p, e
  ) s USING (p, e)
)"""
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
wide AS (SELECT max(len(v)) // 16 AS w FROM kept),
x AS (SELECT vec_id, label, p, v[p * w + 1:p * w + w] AS v FROM kept, wide, range(16) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM x WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
{nearest.format(n=0)},{moved.format(n=0, m=1)},{nearest.format(n=1)},{moved.format(n=1, m=2)},{nearest.format(n=2)},
c AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM c
"""


OP13_SQL = _sql()

"""Exact top-k inner products over integer vectors, norm-sorted with SVD-rotated partial sums.

Vectors are stored by descending length. An orthogonal rotation from the eigenvectors of the Gram
matrix (its SVD) moves most of the energy into the first coordinates, so the partial sum over these,
plus the Cauchy-Schwarz bound on the rest (the product of the residual lengths), bounds the score
from above. A query starts with the k-th best score among the longest vectors as its threshold;
whole chunks fall to the product of lengths, single pairs to the partial bounds, and what is left is
scored exactly in integers. A pair is dropped only when its bound is below the threshold, so ties
stay exact.

Queries go out in blocks of bounded size; each block is one pass over the stored vectors, whose
partitions return their own top k, and a final top k per query merges these.

Cases: a null vector or one with a null or non-finite component takes no part, nor does a null id; pairs
whose sums could leave a long are scored in Python's integers, and a component or a score of the result
that doesn't fit a long is an error; rows that share an id are
queries and candidates each for itself, also for one another; vectors of fewer components are as if ended by zeros; fewer
candidates than k give as many rows; an empty table gives none. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybreak.llm.common import scratch, ship, stored, table

FOUND = "query_row long, query_id long, vec_id long, score long"
HEAD, CHUNK = 4096, 1024
#: Components of a partition, on average, and of a block of queries at most.
PARTITION, BLOCK = 1 << 20, 1 << 21
#: Queries that a chunk is held against at a time: what is alive of a chunk is bounded by this times CHUNK.
TURN = 512
#: Scores below any long count as this one until it is known whether the result needs them.
LOWEST = 1 - (1 << 63)


def integer_vectors(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, with x as a double."""
    x = F.col(vector_col)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(x.isNotNull() & F.col(id_col).isNotNull() & whole)
    too_large = F.raise_error(F.lit(f"a vector's component times {scale} doesn't fit a long")).cast("long")

    def whole_number(c: Column) -> Column:
        scaled = F.lit(float(scale)) * c.cast("double")
        return F.when(F.abs(scaled) >= F.lit(float(1 << 63)), too_large).otherwise(F.floor(scaled).cast("long"))

    ints = F.transform(x, whole_number)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("v"))


def norm_sorted(ints: DataFrame) -> DataFrame:
    """The vectors in partitions by descending length, with a number for each row, stored."""
    length2 = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    rows = ints.withColumn("length2", length2)
    size = rows.agg(F.sum(F.size("v"))).first()[0] or 0
    return stored(rows.repartitionByRange(size // PARTITION + 1, F.desc("length2"), "vec_id").sortWithinPartitions(F.desc("length2"), "vec_id").withColumn("row", F.monotonically_increasing_id()), "vectors")


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of a matrix, ended by zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors of the Gram matrix over all vectors, by descending eigenvalue; width * width sums reach the driver."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column(0), width).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["cell", "x"])

    cells = vectors.select("v").mapInArrow(gram, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toPandas()
    total = np.zeros(width * width)
    total[cells.cell.to_numpy()] = cells.x.to_numpy()
    total = total.reshape(width, width)
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1].copy()


class Searcher:
    """Top k of a block of queries over chunks of vectors."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, turn: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.rows, self.ids, self.queries, self.turn, self.k = rows, ids, queries, turn, k
        width = queries.shape[1]
        self.turned = queries @ turn
        self.lengths = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
        self.cuts = sorted({max(1, width // 8), max(1, width // 3)}) if width else []
        self.rest = [np.sqrt(np.maximum((self.turned[:, c:] ** 2).sum(axis=1), 0)) for c in self.cuts]
        self.threshold = np.full(len(ids), -np.inf) if floor is None else floor.copy()
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]

    def chunk(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        longest = lengths.max(initial=0.0)
        slack = 1e-9 * self.lengths * longest + 1e-6
        active = np.flatnonzero(self.lengths * longest >= self.threshold - slack)
        if not len(active):
            return
        turned = vectors @ self.turn
        left = [np.sqrt(np.maximum((turned[:, cut:] ** 2).sum(axis=1), 0)) for cut in self.cuts]
        for at in range(0, len(active), TURN):
            self._some(active[at : at + TURN], rows, ids, vectors, turned, lengths, left, slack)

    def _some(self, active: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, turned: np.ndarray, lengths: np.ndarray, lefts: list[np.ndarray], slack: np.ndarray) -> None:
        """A chunk against some of the queries."""
        least = (self.threshold - slack)[active]
        q, x = np.nonzero(self.lengths[active, None] * lengths[None, :] >= least[:, None])
        done = 0
        partial = np.zeros(len(q))
        for cut, rest, left in zip(self.cuts, self.rest, lefts):
            if done == 0:
                sums = self.turned[active][:, :cut] @ turned[:, :cut].T
                partial = sums[q, x]
            else:
                partial = partial + np.einsum("ij,ij->i", self.turned[active[q], done:cut], turned[x, done:cut])
            keep = partial + rest[active[q]] * left[x] >= least[q]
            q, x, partial, done = q[keep], x[keep], partial[keep], cut
        q = active[q]
        other = self.rows[q] != rows[x]
        q, x = q[other], x[other]
        score = self._scores(q, vectors, x, self.lengths[q] * lengths[x])
        keep = score >= self.threshold[q]
        q, x, score = q[keep], x[keep], score[keep]
        order = np.lexsort((ids[x], -score, q))
        q, x, score = q[order], x[order], score[order]
        bounds = np.append(np.unique(q, return_index=True)[1], len(q))
        for a, b in zip(bounds[:-1], bounds[1:]):
            b = min(b, a + self.k)
            at = q[a]
            best = sorted([*self.best[at], *zip((-score[a:b]).tolist(), ids[x[a:b]].tolist())])[: self.k]
            self.best[at] = best
            if len(best) == self.k:
                self.threshold[at] = max(self.threshold[at], np.nextafter(float(-best[-1][0]), -np.inf))  # a double may be above the integer

    def _scores(self, q: np.ndarray, vectors: np.ndarray, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Exact scores of pairs, whose absolute values are `bound` at most."""
        score = np.einsum("ij,ij->i", self.queries[q], vectors[x])
        wide = np.flatnonzero(bound >= 1 << 62)
        for at in range(0, len(wide), CHUNK):
            part = wide[at : at + CHUNK]
            exact = (self.queries[q[part]].astype(object) * vectors[x[part]].astype(object)).sum(axis=1)
            if max(exact) >= 1 << 63:
                raise OverflowError("a score doesn't fit a long")
            score[part] = [max(s, LOWEST) for s in exact]
        return score

    def found(self) -> pa.RecordBatch:
        found = [(int(r), int(i), vec, -score) for r, i, best in zip(self.rows, self.ids, self.best) for score, vec in best]
        columns = zip(*found) if found else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_row", "query_id", "vec_id", "score"])


def top_inner_products(vectors: DataFrame, is_query, k: int = 10, query_block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of `vectors` (vec_id, v) where is_query holds, against all others."""
    spark = vectors.sparkSession
    ship(spark)
    data = norm_sorted(vectors)
    queries = data.where(is_query)
    width, n_queries = data.agg(F.max(F.size("v")), F.count(F.when(is_query, 1))).first()
    width = max(width or 0, 1)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n_queries:
        return empty
    turn = rotation(data, width)
    head = data.orderBy(F.desc("length2"), "vec_id").limit(HEAD).select("row", "vec_id", "v").toArrow()
    head_rows, head_ids, head_vectors = head.column(0).to_numpy(), head.column(1).to_numpy(), matrix(head.column(2), width)
    blocks = -(-n_queries // (query_block or max(1, BLOCK // width)))
    path = scratch(spark, "products")
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "vec_id", "v").toArrow()
        if not part.num_rows:
            continue
        rows, ids, asked = part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2), width)
        start = Searcher(rows, ids, asked, turn, k)
        for at in range(0, len(head_ids), CHUNK):
            start.chunk(head_rows[at : at + CHUNK], head_ids[at : at + CHUNK], head_vectors[at : at + CHUNK])
        sent = spark.sparkContext.broadcast((rows, ids, asked, turn, start.threshold))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, ids, asked, turn, floor = sent.value
            searcher = Searcher(rows, ids, asked, turn, k, floor)
            for batch in batches:
                numbers, names, found = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), width)
                for at in range(0, len(names), CHUNK):
                    searcher.chunk(numbers[at : at + CHUNK], names[at : at + CHUNK], found[at : at + CHUNK])
            yield searcher.found()

        data.select("row", "vec_id", "v").mapInArrow(search, FOUND).write.mode("append").parquet(path)
        sent.destroy()
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    best = spark.read.parquet(path).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    too_small = F.raise_error(F.lit("a score doesn't fit a long")).cast("long")
    return best.select("query_id", "rank", "vec_id", F.when(F.col("score") <= LOWEST, too_small).otherwise(F.col("score")).alias("score"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_inner_products(vectors, F.col("vec_id") % 100 == 0)


OP5_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.n <> q.n
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

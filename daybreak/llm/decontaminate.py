"""Benchmark decontamination: size-partitioned MinHash containment search.

Finds short test items inside long documents. Items are partitioned by the number of their distinct
word shingles, in powers of two. A class has a match threshold, an eighth of its smallest size (one at least). An item's
signature holds its shingles of smallest hash: as many as a document that contains `percent` of it can lack, and
the threshold's number. So a document that contains enough of the item has the threshold's number of the
signature or more, whatever the document's length: nothing is missed. A document's signature is scaled to the items, not to its
length: its shingles whose hash isn't above the largest of any item's signature in the block, as only these can meet. They
are looked up in the items' signatures, and an item whose count reaches its class's threshold is verified by exact containment of its whole set.

Signatures and sets are made on the executors; those of a block of items go to all of them: a block's shingles are bounded
(`block_shingles`), and more items make more blocks, each a pass over the documents.

Words are runs of ASCII letters and digits and of non-ASCII characters, in lower case; a text with
fewer words than a shingle has the whole sequence as its one shingle.

Cases: a null or empty text, or one without words, contains nothing and is contained in nothing; rows
that share an id count each for itself, and repeated rows of items or documents repeat their hits; a
null id stays null; empty tables give no hits; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybreak.llm.common import ALNUM, IDENTITY, binary_rows, scratch, shingle_hashes, ship, sorted_sets, stored, table, text_slices, word_hashes

HITS = "doc_id long, item_id long, n_shingles long, n_found long, row long"
TABLE_BITS = 22


def shingles(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, shingle hashes of these rows in order, their number by row)."""
    for row, end, data, offsets in text_slices(pc.utf8_lower(column)):
        words, counts = word_hashes(data, offsets, ALNUM, IDENTITY)
        yield row, end, *shingle_hashes(words, counts, size)


def threshold(size: int) -> int:
    """The matches that the signature of an item of so many shingles asks for: an eighth of the smallest size of its class."""
    return max(1, (1 << (size.bit_length() - 1)) // 8)


def signature_size(size: int, percent: int) -> int:
    """The shingles that a containing document can lack, and as many as must match."""
    return min(size, size - -(-percent * size // 100) + threshold(size))


class Items:
    """The sets and signatures of a block of items."""

    def __init__(self, ids: list[int | None], sets: list[np.ndarray], percent: int):
        self.ids, self.sets, self.percent = ids, sets, percent
        keys = [hashes[: signature_size(len(hashes), percent)] for hashes in sets]  # the sets ascend
        owners = np.repeat(np.arange(len(sets)), [len(k) for k in keys])
        self.least = np.array([threshold(len(hashes)) for hashes in sets])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        self.largest = self.keys[-1]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[keys & np.uint64((1 << TABLE_BITS) - 1)] = True

    def hits(self, hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, shingles found) of verified pairs."""
        near = np.flatnonzero(hashes <= self.largest)
        near = near[self.table[hashes[near] & np.uint64((1 << TABLE_BITS) - 1)]]
        first, last = (np.searchsorted(self.keys, hashes[near], side=s) for s in ("left", "right"))
        each = last - first
        ends = np.cumsum(counts)
        rows = np.repeat(np.searchsorted(ends, near, side="right"), each)
        at = np.repeat(first - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
        met = np.unique(np.stack([rows, self.owners[at], self.keys[at].view(np.int64)], axis=1), axis=0)  # a shingle counts once for a document
        if not len(met):
            return
        begin = np.flatnonzero(np.append(True, (met[1:, :2] != met[:-1, :2]).any(axis=1)))
        matches = np.diff(np.append(begin, len(met)))
        of_row: tuple[int, np.ndarray] = (-1, hashes[:0])
        for (row, item, _), n in zip(met[begin].tolist(), matches.tolist()):
            if n < self.least[item]:
                continue
            if of_row[0] != row:
                of_row = row, np.unique(hashes[ends[row] - counts[row] : ends[row]])
            wanted, there = self.sets[item], of_row[1]
            place = np.minimum(np.searchsorted(there, wanted), len(there) - 1)
            found = int((there[place] == wanted).sum())
            if 100 * found >= self.percent * len(wanted):
                yield row, item, found


def contained_items(docs: DataFrame, items: DataFrame, **options: int | str) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found): each document and each item of which it contains percent or more."""
    return contained_rows(docs, items, **options).drop("row")


def contained_rows(
    docs: DataFrame,
    items: DataFrame,
    *,
    shingle_words: int = 5,
    percent: int = 80,
    block_shingles: int = 1 << 21,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, row): each document and each item of which it contains percent or more.

    row is the document's row key, a hash of its id and text.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("row"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, hashes, counts in shingles(batch.column(1), shingle_words):
                sets, sizes = sorted_sets(hashes, counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(sizes), binary_rows(sets, sizes)], ["item_id", "size", "shingles"])

    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    described = stored(named.mapInArrow(describe, "item_id long, size long, shingles binary").where("size > 0"), "items")
    total = described.agg(F.sum("size")).first()[0] or 0
    blocks = -(-total // block_shingles)
    path = scratch(spark, "hits")
    for block in range(blocks):
        part = described.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) == block).select("item_id", "shingles").toArrow()
        if not part.num_rows:
            continue
        ids = part.column(0).to_pylist()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(1)]
        sent = spark.sparkContext.broadcast((ids, sets))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items(*sent.value, percent)
            for batch in batches:
                for row, _, hashes, counts in shingles(batch.column(1), shingle_words):
                    found = list(known.hits(hashes, counts)) if len(hashes) else []
                    if found:
                        at, item, n = zip(*found)
                        columns = [batch.column(0).take(pa.array(np.array(at) + row)), pa.array([known.ids[i] for i in item], pa.int64()), pa.array([len(known.sets[i]) for i in item], pa.int64()), pa.array(n, pa.int64()), batch.column(2).take(pa.array(np.array(at) + row))]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_shingles", "n_found", "row"])

        texts.mapInArrow(search, HITS).write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(HITS).parquet(path) if blocks else spark.createDataFrame([], HITS)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH t AS (
  SELECT true AS doc, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark
), w AS (
  SELECT doc, id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM t
), s AS (
  SELECT doc, id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), i AS (SELECT id AS item_id, len(s) AS n, unnest(s) AS h FROM s WHERE NOT doc),
d AS (SELECT id AS doc_id, unnest(s) AS h FROM s WHERE doc)
SELECT doc_id, item_id, any_value(n)::BIGINT AS n_shingles, count(*)::BIGINT AS n_found
FROM d JOIN i USING (h) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n)
"""

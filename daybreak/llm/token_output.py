"""Token-ID output: Parquet list columns with dictionary or delta encoding, row groups and page indexes.

`write_tokens` range-partitions the documents by id, encodes each partition in ascending id order
and writes one Parquet file per partition: the ids as a list column, beside small metadata columns
(`part`, `local_start`, `n_tokens`). Row groups and pages have set sizes and Parquet's page indexes
are on, so a reader that wants metadata, a few documents or a range of the token stream touches only
those columns, files, row groups and pages. `read_tokens` and `read_token_range` are these readers.

Cases: a null text counts as empty and has only the end id; a null document id sorts first; documents
with the same id follow one another in the order of a hash of their texts, in several files if they are many; an empty table writes an empty file
set; other columns of the input are ignored. Texts are encoded whole, however long.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybreak.llm import tokens
from daybreak.llm.common import scratch, ship, table

#: Bytes of text of a file, on average.
PARTITION_BYTES = 24 << 20
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def write_tokens(
    docs: DataFrame,
    path: str,
    *,
    tokenizer: str | None = None,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
) -> str:
    """Writes the token files of `docs` below `path` and returns it.

    encoding: "dictionary" (ids as indexes into a dictionary page) or "delta" (Parquet's second
    page version, DELTA_BINARY_PACKED).
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding: {encoding}")
    ship(docs.sparkSession)
    vocabulary = tokenizer or tokens.default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, start = context.partitionId() if context else 0, 0
        codec = tokens.encoder(vocabulary)
        for batch in batches:
            for row, end, ids, counts in codec.column(batch.column(1), end_id):
                offsets = np.concatenate([[0], np.cumsum(counts)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(np.full(end - row, part, np.int32)), pa.array(start + offsets[:-1], pa.int64()), pa.array(counts, pa.int64()), lists],
                    ["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                start += int(offsets[-1])

    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("turn"))
    dealt = rows.repartitionByRange(size // PARTITION_BYTES + 1, "doc_id", "turn").sortWithinPartitions("doc_id", "turn", "text")
    encoded = dealt.select("doc_id", "text").mapInArrow(encode, SCHEMA)
    delta = encoding == "delta"
    (
        encoded.write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.enable.dictionary", str(not delta).lower())
        .option("parquet.writer.version", "PARQUET_2_0" if delta else "PARQUET_1_0")
        .option("compression", "zstd")
        .parquet(path)
    )
    return path


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its part and the number of ids in the files before it. Reads metadata columns only."""
    sums = spark.read.parquet(path).groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0).cast("long")).alias("part_start"))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens[, ids]); doc_ids and with_ids=False become Parquet filters and column pruning."""
    rows = spark.read.parquet(path)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(list(doc_ids)))
    start = (F.col("part_start") + F.col("local_start")).alias("start")
    return rows.join(part_starts(spark, path), "part").select("doc_id", start, "n_tokens", *["ids"] * with_ids)


def read_token_range(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """The ids at positions begin to end - 1 of the whole stream, by document: (doc_id, start, ids)."""
    rows = read_tokens(spark, path).where((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > begin))
    skip = F.greatest(F.lit(begin) - F.col("start"), F.lit(0)).cast("int")
    stop = F.least(F.lit(end) - F.col("start"), F.col("n_tokens")).cast("int")
    return rows.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", skip + 1, stop - skip).alias("ids"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
        at = lists.offsets.to_numpy().astype(np.int64) * 4
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("local_start"), pa.array(np.diff(at) // 4, pa.int64()), pa.array(sums, pa.int64())],
            ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"],
        )


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the token stream and the crc32 of its ids, from the files read back."""
    path = write_tokens(table(spark, sf_dir, "documents"), scratch(spark, "tokens"))
    rows = spark.read.parquet(path).mapInArrow(_digest, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    start = (F.col("part_start") + F.col("local_start")).alias("start")
    return rows.join(part_starts(spark, path), "part").select("doc_id", start, "n_tokens", "ids_crc32")

"""Packing: lexical retrieval packing of whole corpora into windows of a fixed number of tokens.

Every document is tokenised whole and ends with `end_id`. Documents are dealt into shards of bounded
token count in the order of a MinHash value of their token ids, weighted towards rare ids, of one of
their runs of four ids, and of their id, so that a shard holds lexically near documents, copies
foremost, and a hot signature fills several shards. Both values are scattered: as they come, long
documents have the least ones and would fill shards of their own. A seed's neighbours are looked up in
its own shard only. Each shard builds a
BM25 inverted index over its documents, with document frequencies and the average length taken over
all documents. A seed document opens a window; its unused neighbours, by descending BM25 score, fill
it; the piece that doesn't fit is cut and its rest stays in the index. A document's full windows need
no neighbours. The rest of a shard that is shorter than a window becomes sequences whose lengths are
powers of two, so nothing is padded.

Cases: a null text counts as empty and has the end id only; rows with the same id are documents of
their own; an empty table gives no pieces; other columns are ignored; texts of any length are cut
into as many pieces as they need. Ties of score go to the earlier document of the shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybreak.llm import tokens
from daybreak.llm.common import binary_rows, mix64, odd_multipliers, ship, stored, table

#: Bits of the signature that the MinHash value of runs takes; the 21 above them are of single ids.
RUN_BITS = 42
#: Tokens of a partition on average: near signatures gather long documents, which must fit an executor a few times over.
PARTITION = 1 << 21
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def weighted_order(vocabulary: int, end_id: int) -> np.ndarray:
    """The rank of each id in a weighted MinHash order, which a later id leads the more often.

    Byte-pair ids are numbered by merge, so late ids are rare in most texts. Every document has `end_id`: it comes last.
    """
    ids = np.arange(vocabulary, dtype=np.uint64)
    chance = ((mix64((ids + np.uint64(1)) * odd_multipliers(1, 3)[0]) >> np.uint64(11)).astype(float) + 1) / (1 << 53)
    key = -np.log(chance) / (ids + np.uint64(1)).astype(float)
    key[end_id] = np.inf
    out = np.empty(vocabulary, np.uint64)
    out[np.argsort(key, kind="stable")] = ids
    return out


def signatures(ids: np.ndarray, counts: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """One number for each document: its scattered MinHash value of single ids over that of its runs of four ids.

    Runs are told apart by 16 bits of each id; documents of fewer than four ids share one value of runs.
    """
    ends = np.cumsum(counts)
    single = np.minimum.reduceat(rank[ids], ends - counts)
    packed = np.append(ids, np.zeros(3, ids.dtype)).astype("<u2")
    runs = np.ndarray(len(ids), "<u8", packed, strides=(2,)) * odd_multipliers(1, 5)[0]
    for k in range(1, 4):  # runs that begin in a document's last three places leave it
        runs[(ends - k)[counts >= k]] = np.iinfo(np.uint64).max
    run = np.minimum.reduceat(runs, ends - counts)
    top = mix64(single + np.uint64(1)) >> np.uint64(1 + RUN_BITS)
    return (top << np.uint64(RUN_BITS) | mix64(run) >> np.uint64(64 - RUN_BITS)).astype(np.int64)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(signature, doc_id, ids) of every document."""
    return documents(encoded(docs, tokenizer, end_id, id_col, text_col))


def documents(rows: DataFrame) -> DataFrame:
    return rows.where("ids is not null").select("signature", "doc_id", "ids")


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(signature, doc_id, ids) of every document, and (term, n) rows of each task, in one pass.

    ids are little-endian unsigned integers of 16 bits where the vocabulary allows it, of 32 otherwise. Documents share
    the upper part of their signature with a chance equal to the weighted Jaccard similarity of their ids at least, the lower one with that of their runs. n counts the task's documents that hold the term; the terms -1 and -2 stand for its documents and ids.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokens.encoder(tokenizer)
        rank = weighted_order(max(len(codec.ends), end_id + 1), end_id)
        width = len(rank)
        narrow = id_type(width)
        found, docs, total = np.zeros(width, np.int64), 0, 0
        names = ["signature", "doc_id", "ids", "term", "n"]
        for batch in batches:
            for row, end, ids, counts in codec.column(batch.column(1), end_id):
                held = np.repeat(np.arange(len(counts), dtype=np.uint64) << np.uint64(32), counts) | ids
                held.sort()
                once = np.append(True, held[1:] != held[:-1])
                found += np.bincount((held[once] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=width)
                docs, total = docs + len(counts), total + len(ids)
                nothing = pa.nulls(len(counts), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(signatures(ids, counts, rank)), batch.column(0).slice(row, end - row), binary_rows(ids.astype(narrow), counts), nothing, nothing], names)
        term = np.flatnonzero(found)
        nothing = pa.nulls(len(term) + 2, pa.int64())
        yield pa.RecordBatch.from_arrays([nothing, nothing, pa.nulls(len(nothing), pa.binary()), pa.array(np.append(term, [-1, -2]), pa.int64()), pa.array(np.append(found[term], [docs, total]), pa.int64())], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, "signature long, doc_id long, ids binary, term long, n long")


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def document_frequencies(tokenized: DataFrame, vocabulary: int) -> tuple[np.ndarray, int, int]:
    """Documents holding each id, the number of documents and of ids, over all documents.

    What reaches the driver is bounded by the vocabulary.
    """
    sums = tokenized.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(vocabulary + 2, np.int64)
    out[sums.term.to_numpy(np.int64)] = sums.n.to_numpy(np.int64)  # -1 and -2 are the last two places
    return out[:vocabulary], int(out[-1]), int(out[-2])


class Shard:
    """The inverted index of one shard and the windows filled from it."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, average: float, window: int, k1: float, b: float):
        self.docs, self.window = docs, window
        terms, rows, weights, ends = [], [], [], [0]
        for at, ids in enumerate(docs):
            term, count = np.unique(ids, return_counts=True)
            terms.append(term)
            rows.append(np.full(len(term), at, np.int32))
            weights.append(idf[term] * count * (k1 + 1) / (count + k1 * (1 - b + b * len(ids) / average)))
            ends.append(ends[-1] + len(term))
        flat = np.concatenate(terms)
        order = np.argsort(flat, kind="stable")
        self.rows, self.weights = np.concatenate(rows)[order], np.concatenate(weights)[order]
        known, begin = np.unique(flat[order], return_index=True)
        self.begin = np.append(begin, len(flat))
        self.places = np.searchsorted(known, flat)  # the posting list of each document's terms
        self.ends = ends
        self.left = np.array([len(d) % window for d in docs])

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents that share a term with the seed, by descending BM25 score."""
        lists = self.places[self.ends[seed] : self.ends[seed + 1]]
        spans = [slice(a, b) for a, b in zip(self.begin[lists], self.begin[lists + 1])]
        score = np.bincount(np.concatenate([self.rows[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), len(self.docs))
        score[self.left == 0] = 0
        score[seed] = 0
        best = np.flatnonzero(score > 0)
        return best[np.argsort(-score[best], kind="stable")]

    def pieces(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, start, length, sequence from 0, offset)."""
        window, sequence = self.window, 0
        for at, ids in enumerate(self.docs):
            for start in range(0, len(ids) - window + 1, window):
                yield at, start, window, sequence, 0
                sequence += 1
        used = 0
        last: list[tuple[int, int, int]] = []
        for seed in range(len(self.docs)):
            while self.left[seed]:
                for at in [seed, *(self.neighbours(seed) if used + self.left[seed] < window else ())]:
                    length = int(min(self.left[at], window - used))
                    last.append((int(at), len(self.docs[at]) - int(self.left[at]), length))
                    self.left[at] -= length
                    used += length
                    if used == window:
                        break
                if used == window:
                    yield from self._placed(last, [window], sequence)
                    sequence, used, last = sequence + 1, 0, []
        if used:
            sizes = [1 << k for k in range(used.bit_length() - 1, -1, -1) if used >> k & 1]
            yield from self._placed(last, sizes, sequence)

    @staticmethod
    def _placed(parts: list[tuple[int, int, int]], sizes: list[int], sequence: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Parts laid one after the other into sequences of these sizes, which they fill."""
        which, offset = 0, 0
        for at, start, length in parts:
            while length:
                take = min(length, sizes[which] - offset)
                yield at, start, take, sequence + which, offset
                start, length, offset = start + take, length - take, offset + take
                if offset == sizes[which]:
                    which, offset = which + 1, 0


def pack(
    docs: DataFrame,
    *,
    window: int = 2048,
    tokenizer: str | None = None,
    end_id: int = 1,
    shard_tokens: int = 1 << 19,
    k1: float = 1.2,
    b: float = 0.75,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer or tokens.default_path()
    counted = stored(encoded(docs, path, end_id, id_col, text_col), "packing-ids")
    vocabulary = max(len(tokens.encoder(path).ends), end_id + 1)
    frequency, n_docs, n_ids = document_frequencies(counted, vocabulary)
    weight = np.log1p((n_docs - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    idf, average = spark.sparkContext.broadcast(weight), n_ids / max(n_docs, 1)  # one number per vocabulary entry

    narrow = id_type(vocabulary)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 32
        names: list[int | None] = []
        docs: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            rows = list(Shard(docs, idf.value, average, window, k1, b).pieces())
            at, start, length, number, offset = (np.array(x, np.int64) for x in zip(*rows))
            ids = np.concatenate([docs[d][s : s + n] for d, s, n in zip(at, start, length)])
            sizes = np.array([len(d) for d in docs])
            out = [pa.array([names[d] for d in at], pa.int64()), pa.array(start), pa.array(length), binary_rows(ids.astype("<u4"), length), pa.array(sizes[at]), pa.array(number + sequence), pa.array(offset)]
            sequence += int(number.max()) + 1
            return pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        held = 0
        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(name)
                docs.append(np.frombuffer(x.as_buffer(), narrow))
                held += len(docs[-1])
                if held >= shard_tokens:
                    yield flush()
                    held, names, docs = 0, [], []
        if docs:
            yield flush()

    return documents(counted).repartitionByRange(n_ids // PARTITION + 1, "signature", "doc_id").sortWithinPartitions("signature", "doc_id", "ids").select("doc_id", "ids").mapInArrow(fill, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): each sequence's ids in order; a sequence holds one window at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select("sequence_id", "length", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

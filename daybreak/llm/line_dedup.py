"""Fuzzy line dedup by MinHash: one line of every component of similar lines stays.

A line is what stands between two newlines, without a carriage return at its end. Lines of nothing
but white space always stay. A line's set holds its distinct runs of `shingle_chars` characters (a
shorter line: itself). Its signature is a one-permutation MinHash of 128 bins, whose empty bins are
filled by fixed probing, and `bands` bands of `rows` bins each (of other bins each, as long as there are
any) are its postings. Lines that share a band are confirmed on their full sets at a Jaccard similarity of
`percent` or more, and a distributed union-find over the confirmed links gives the components, exact
copies included. Of each component the first line by (document id, line number) stays; the others go
with their newline.

Lines are told apart by a 64-bit hash of their bytes, so that a task posts exact copies once
and texts travel only for lines that met in a band. At similarity 0.8 a link meets in no band with a
measured chance of two to four in a thousand, at 0.85 of up to two in ten thousand; it is lost unless
other links connect its lines. Lists of more than 16 lines are settled by stars, and by pairs of what these don't join (see `near`).

Cases: a null text stays null and has no lines; an empty text has none that could go; rows are told apart
by id and text, so rows that share an id lose their own lines only, and exact repeats of a row
keep the same lines; a null id comes first; an empty table gives no rows; other columns stay as they are,
but for one called `removed_col`, which is replaced; a line of any length is one line, a text of any
length is read in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybreak.llm import near
from daybreak.llm.common import NOT_SPACE, POWER, bitset, filter_bits, fresh, in_bitset, mix64, odd_multipliers, powers, remove, ship, sorted_sets, stored, table, text_slices

BINS = 128
#: For each bin the order in which other bins may fill it, itself first.
_ORDERS = np.stack([np.append(b, np.random.default_rng(20 + b).permutation(np.delete(np.arange(BINS), b))) for b in range(BINS)])
#: Bytes whose arrays stay in the processor's cache.
PART = 1 << 15
_POWERS = powers(PART)
_INVERSE = pow(int(POWER), -1, 1 << 64)
_INVERSES = np.cumprod(np.append(np.uint64(1), np.full(PART - 1, _INVERSE, np.uint64)), dtype=np.uint64)
#: Bytes of a part of a long text, unless a line is longer.
LONG = 1 << 20


def prefix_sums(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Before each of the ascending places `cuts`: the hash of the bytes so far, as a sum over places, and how many aren't white space."""
    hashes, solid = np.zeros(len(cuts), np.uint64), np.zeros(len(cuts), np.int64)
    ranges = np.searchsorted(cuts, np.arange(0, len(data) + PART, PART), side="right")
    sum_so_far, solid_so_far = np.zeros(1, np.uint64), 0
    for k, begin in enumerate(range(0, len(data), PART)):
        piece = data[begin : begin + PART]
        scale = np.array([pow(int(POWER), begin, 1 << 64)], np.uint64)
        sums = np.cumsum((piece + np.uint64(1)) * _POWERS[: len(piece)], dtype=np.uint64)
        dense = np.cumsum(NOT_SPACE[piece], dtype=np.int32)
        a, b = ranges[k], ranges[k + 1]
        at = cuts[a:b] - begin - 1
        hashes[a:b] = sums[at] * scale + sum_so_far
        solid[a:b] = dense[at] + solid_so_far
        sum_so_far = sum_so_far + sums[-1] * scale
        solid_so_far += int(dense[-1])
    return hashes, solid


class Lines:
    """The lines of a part of a column: begin and end bytes, row, number in the row, whether they hold anything, and id."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first_number: int = 0):
        self.data = data
        rows = len(offsets) - 1
        breaks = np.flatnonzero(data == 10)
        home = np.searchsorted(offsets, breaks, side="right") - 1
        per_row = np.bincount(home, minlength=rows) + 1
        first = np.cumsum(per_row) - per_row
        self.row = np.repeat(np.arange(rows), per_row)
        self.number = np.arange(len(self.row)) - np.repeat(first, per_row) + first_number
        opens = np.ones(len(self.row), bool)
        opens[first] = False
        self.begin = np.empty(len(self.row), np.int64)
        self.begin[first], self.begin[opens] = offsets[:-1], breaks + 1
        self.end = np.empty(len(self.row), np.int64)
        closes = np.ones(len(self.row), bool)
        closes[first + per_row - 1] = False
        self.end[first + per_row - 1], self.end[closes] = offsets[1:], breaks
        some = self.end > self.begin
        self.end[some] -= data[self.end[some] - 1] == 13
        cuts = np.stack([self.begin, self.end], axis=1).ravel()  # they ascend
        sums, solid = prefix_sums(data, cuts)
        self.solid = solid[1::2] > solid[::2]
        sizes = (self.end - self.begin).astype(np.uint64)
        away = np.array([pow(_INVERSE, PART * k, 1 << 64) for k in range(len(data) // PART + 1)], np.uint64)
        names = (sums[1::2] - sums[::2]) * away[self.begin // PART] * _INVERSES[self.begin % PART]
        self.id = mix64(names + sizes * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)

    def text(self, at: int) -> bytes:
        return self.data[self.begin[at] : self.end[at]].tobytes()

    def parts(self, at: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """The lines `at` in parts that stay in the cache: (which of them, their bytes, begins, ends)."""
        sizes = self.end[at] - self.begin[at]
        total = np.cumsum(sizes)
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(total, total[i] - sizes[i] + 2 * PART, side="right")))
            ends = total[i:j] - total[i] + sizes[i]
            begins = ends - sizes[i:j]
            source = np.arange(int(ends[-1])) - np.repeat(begins - self.begin[at[i:j]], sizes[i:j])
            yield slice(i, j), self.data[source] if j > i + 1 else self.data[self.begin[at[i]] : self.end[at[i]]], begins, ends
            i = j


def line_shingles(data: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character runs of each line, in order, and their number."""
    a, b = begin, end
    if len(data) and data.max() >= 128:
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
        place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        a, b = place[begin], place[end]
    else:
        points = data.astype(np.uint64)
    factors = odd_multipliers(size, 31)
    padded = np.concatenate([points, np.zeros(size - 1, np.uint64)])
    rolled = padded[: len(points)] * factors[0]
    for j in range(1, size):
        rolled += padded[j : j + len(points)] * factors[j]
    counts = np.maximum(b - a - size + 1, 1)
    short = np.flatnonzero(b - a < size)
    for line in short:
        own = points[a[line] : b[line]]
        if len(own):
            rolled[a[line]] = (own * factors[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own) + 1)
    at = np.cumsum(counts) - counts
    source = np.arange(int(counts.sum())) - np.repeat(at - a, counts)
    return mix64(rolled[source]), counts


NONE = np.uint64((1 << 64) - 1)


def bin_minima(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(lines, BINS): the smallest 45 bits of a hash in each bin, NONE where there isn't any.

    At most 2^12 lines at a time: a hash's 45 bits stand below its line and bin, so that one sort has
    the smallest of each first.
    """
    lines = len(counts)
    low = np.uint64((1 << 45) - 1)
    packed = np.repeat(np.arange(lines, dtype=np.uint64) << np.uint64(52), counts)
    packed |= (hashes >> np.uint64(57)) << np.uint64(45)
    packed |= hashes & low
    packed.sort()
    slot = packed >> np.uint64(45)
    first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
    out = np.full(lines * BINS, NONE, np.uint64)
    out[slot[first].astype(np.int64)] = packed[first] & low
    return out.reshape(lines, BINS)


def densified(out: np.ndarray) -> np.ndarray:
    """The minima with empty bins filled from others in the order of a fixed permutation."""
    known = out != NONE
    line, empty = np.nonzero(~known)
    for turn in range(1, BINS):
        if not len(line):
            break
        source = _ORDERS[empty, turn]
        full = known[line, source]
        out[line[full], empty[full]] = out[line[full], source[full]]
        line, empty = line[~full], empty[~full]
    return out


def one_permutation(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(lines, BINS): the signatures of lines with these shingles; 2^12 lines at a time."""
    return densified(bin_minima(hashes, counts))


def signatures(lines: Lines, at: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which of the lines `at`, their signatures), in parts."""
    held, first, end = [], 0, 0
    for which, data, begins, ends in lines.parts(at):
        minima = None
        if len(data) <= 8 * PART:
            minima = bin_minima(*line_shingles(data, begins, ends, size))
        else:  # one long line, by pieces that overlap by a run of characters (of four bytes at most)
            for begin in range(0, len(data), 8 * PART):
                a, b = begin, min(len(data), begin + 8 * PART + 4 * size)
                while a < b and data[a] & 0xC0 == 0x80:
                    a += 1
                while b < len(data) and data[b] & 0xC0 == 0x80:
                    b -= 1
                if begin and len(data[a:b].tobytes().decode("utf-8", "replace")) < size:
                    continue  # the piece before has the end
                piece = bin_minima(*line_shingles(data[a:b], np.array([0]), np.array([b - a]), size))
                minima = piece if minima is None else np.minimum(minima, piece)
        held.append(minima)
        end = which.stop
        if end - first >= 2048:
            yield np.arange(first, end), densified(np.concatenate(held))
            held, first = [], end
    if held:
        yield np.arange(first, end), densified(np.concatenate(held))


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    each = BINS // rows  # bands that share no bin
    turns = [np.random.default_rng(1000 + t).permutation(BINS)[: each * rows].reshape(each, rows) for t in range(-(-bands // each))]
    pick = np.concatenate(turns)[:bands]
    factors = odd_multipliers(rows, 9)
    sums = np.stack([(signature[:, bins] * factors).sum(axis=1, dtype=np.uint64) for bins in pick], axis=1)
    return mix64(sums + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def line_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Distinct shingles of texts that are one line each, ascending by row."""
    for row, end, data, offsets in text_slices(column, 1 << 16):
        hashes, counts = line_shingles(data, offsets[:-1], offsets[1:], size)
        yield row, end, *sorted_sets(hashes, counts)


def slices_of_lines(column: pa.Array) -> Iterator[tuple[int, int, Lines]]:
    """(first row, end row, lines) of parts of a column; a long text comes in several parts."""
    for row, end, data, offsets in text_slices(column, 1 << 18):
        if len(data) <= 2 * LONG:
            yield row, end, Lines(data, offsets)
            continue
        begin, number = 0, 0  # one text
        while begin <= len(data):
            stop = begin + LONG
            while stop < len(data) and not (found := np.flatnonzero(data[stop : stop + LONG] == 10)).size:
                stop += LONG
            stop = stop + int(found[0]) if stop < len(data) else len(data)
            lines = Lines(data[begin:stop], np.array([0, stop - begin]), number)
            yield row, end, lines
            begin, number = stop + 1, number + len(lines.row)


class Seen:
    """Ids that a task has had: a table of fixed size, in which newer ones replace older ones."""

    def __init__(self, bits: int = 18):
        self.table = np.zeros(1 << bits, np.int64)

    def new(self, ids: np.ndarray) -> np.ndarray:
        slot = ids & (len(self.table) - 1)
        out = self.table[slot] != ids
        self.table[slot] = ids
        return out


def similar_lines(postings: DataFrame, texts: DataFrame, bits: int, percent: int, shingle_chars: int) -> DataFrame:
    """(id, root) of the lines that aren't the root of their component; texts has one column."""
    spark = texts.sparkSession
    found = near.found_pairs(postings, "line-pairs", bits, max(1, (1 << bits) // 4))
    candidates = near.Candidates(found)
    remove(found)
    met = stored(candidates.ids(), "met-ids")
    sent = spark.sparkContext.broadcast(bitset(met, filter_bits(met.count())))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = sent.value, Seen()
        for batch in batches:
            for _, _, lines in slices_of_lines(batch.column(0)):
                at = np.flatnonzero(in_bitset(known, lines.id) & lines.solid)
                at = at[seen.new(lines.id[at])]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(lines.id[at]), pa.array([lines.text(i).decode() for i in at], pa.string())], ["id", "line"])

    bodies = stored(texts.mapInArrow(fetch, "id long, line string").join(met, "id").dropDuplicates(["id"]), "met-lines")
    remove(met)

    def confirm(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(bodies.toDF("a", "ta"), "a").join(bodies.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
        return joined.mapInArrow(near.similar(lambda column: line_sets(column, shingle_chars), percent), "a long, b long")

    def marks(ids: DataFrame) -> DataFrame:
        of = near.marked(lambda column: line_sets(column, shingle_chars), 1024)
        return bodies.join(ids, "id").select("id", "line").mapInArrow(of, "id long, size long, mark binary")

    roots = near.linked(candidates, confirm, near.Rest(marks, percent))
    candidates.drop()
    remove(bodies)
    return roots


def dedup_lines(
    docs: DataFrame,
    *,
    percent: int = 80,
    shingle_chars: int = 5,
    bands: int = 20,
    rows: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
    removed_col: str = "removed_lines",
) -> DataFrame:
    """The documents with their repeated lines gone from `text_col`, and the numbers of these lines (from 0) in `removed_col`."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop(*[c for c in docs.columns if c.lower() == removed_col.lower() and c not in (id_col, text_col)])
    key, gone_key = fresh("row_key", docs), fresh("gone_key", docs)
    row_key = F.xxhash64(F.col(id_col), F.col(text_col))
    typed = dict(docs.dtypes)[id_col]
    size, count = docs.agg(F.sum(F.octet_length(F.col(text_col))), F.count("*")).first()
    bits = near.bucket_bits(((size or 0) // 64 + count) * bands)  # lines of 64 bytes: shorter ones make larger buckets
    names = [*near.Postings.NAMES, "row", "doc", "number", "id"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = near.Postings(bits), Seen()
        places: list[pa.RecordBatch] = []

        def posted(batch: pa.RecordBatch) -> pa.RecordBatch:
            nothing = [pa.nulls(batch.num_rows, f.type) for f in (pa.field("row", pa.int64()), pa.field("doc", doc_type), pa.field("number", pa.int32()), pa.field("id", pa.int64()))]
            return pa.RecordBatch.from_arrays([*batch.columns, *nothing], names)

        def listed() -> pa.RecordBatch:
            held = pa.concat_batches(places)
            places.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(held.num_rows, pa.int64()), pa.nulls(held.num_rows, pa.binary()), *held.columns], names)

        doc_type = None
        for batch in batches:
            doc_type = batch.schema.field(1).type
            for row, _, lines in slices_of_lines(batch.column(2)):
                keep = np.flatnonzero(lines.solid)
                if not len(keep):
                    continue
                home = pa.array(lines.row[keep] + row)
                places.append(pa.RecordBatch.from_arrays([batch.column(0).take(home), batch.column(1).take(home), pa.array(lines.number[keep].astype(np.int32)), pa.array(lines.id[keep])], names[2:]))
                if sum(p.num_rows for p in places) > 1 << 16:
                    yield listed()
                ids, at = np.unique(lines.id[keep], return_index=True)
                unseen = seen.new(ids)
                ids, at = ids[unseen], keep[at[unseen]]
                for which, signature in signatures(lines, at, shingle_chars):
                    for batch_out in out.add(band_keys(signature, bands, rows), ids[which]):
                        yield posted(batch_out)
        if places:
            yield listed()
        if out.held:
            yield posted(out.flush())

    described = stored(docs.select(row_key.alias("row"), F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(describe, f"{near.Postings.SCHEMA}, row long, doc {typed}, number int, id long"), "lines")
    postings = described.where("bucket is not null").select(*near.Postings.NAMES)
    roots = similar_lines(postings, docs.select(text_col), bits, percent, shingle_chars)
    places = described.where("id is not null").select("row", "doc", "number", "id")
    repeated = places.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    several = repeated.unionByName(roots.select("id")).unionByName(roots.select(F.col("root").alias("id"))).distinct()
    named = several.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    # only lines of components of two lines or more can go
    occurring = stored(places.join(named, "id"), "occurrences")
    remove(described, roots)
    kept = occurring.groupBy("root").agg(F.min(F.struct("doc", "number", "row")).alias("kept"))
    gone = occurring.join(kept, "root").where(~F.struct("doc", "number", "row").eqNullSafe(F.col("kept")))
    per_row = gone.groupBy(F.col("row").alias(gone_key)).agg(F.sort_array(F.collect_set("number")).alias(removed_col))

    at = docs.columns.index(text_col)
    kept_columns = [F.col(f"`{c}`") for c in docs.columns]

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = batch.column(batch.num_columns - 1)
            some = np.flatnonzero(pc.greater(pc.list_value_length(drops), 0).to_numpy(zero_copy_only=False))
            columns = list(batch.columns)
            if len(some):
                texts = columns[at].take(pa.array(some)).to_pylist()
                for k, (text, numbers) in enumerate(zip(texts, drops.take(pa.array(some)).to_pylist())):
                    out = set(numbers)
                    texts[k] = "\n".join(line for n, line in enumerate(text.split("\n")) if n not in out)
                mask = np.zeros(batch.num_rows, bool)
                mask[some] = True
                columns[at] = pc.replace_with_mask(columns[at], pa.array(mask), pa.array(texts, columns[at].type))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    joined = docs.withColumn(key, row_key).join(per_row, F.col(key) == F.col(gone_key), "left").select(*kept_columns, F.coalesce(F.col(f"`{removed_col}`"), F.array().cast("array<int>")).alias(removed_col))
    return joined.mapInArrow(rebuild, joined.schema)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: its lines, how many went, and the size and sha256 of the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with_lines = docs.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))))
    out = dedup_lines(with_lines)
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("n_lines").cast("long"), F.size("removed_lines").cast("long").alias("n_removed"), F.octet_length(kept).cast("long").alias("kept_bytes"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))

"""Suffix-array dedup: maximal repeats from the common-prefix interval tree of an enhanced suffix array.

A window is a string of `length` bytes. Every window is dealt to a bucket by its minimiser: the k-gram
of smallest hash in it (the leftmost of equals). Equal windows have equal minimisers, so they meet in
one bucket, and the consecutive windows of a document that share a minimiser travel as one segment.
Segments that repeat inside a flush travel once. In its bucket a segment is first reduced to windows
whose hash occurs again; the suffixes of the distinct remaining segments that start such windows are
sorted with their longest common prefixes (the enhanced suffix array), and a stack scan of these
visits the interval tree: an interval of depth >= length whose suffixes have more than one left
neighbour is a maximal repeat group with all its occurrences. A group's occurrences in documents
other than the smallest are repeats; bytes they cover are what removal takes away.

Every shared window lies in a maximal repeat of its bucket, so the union of the groups' occurrences is
the union of all windows that an earlier document has. A segment's context ends where its windows
end, so a group's length is that inside its minimiser's segments.

Cases: a null text counts as empty; texts shorter than a window repeat nothing; equal documents leave
the smallest id whole; rows that share an id are one document to each other: their common windows
aren't repeats unless a smaller id has them; a null id is larger than every other; an empty table
gives no rows; other columns are ignored. Bytes are compared, so a match may begin or end inside a
character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybreak.llm.common import mix64, powers, ship, table, text_slices

GRAM = 10
NO_ID = np.iinfo(np.int64).max


#: Bytes whose arrays stay in the processor's cache: places in such a part have PART_BITS bits.
PART_BITS = 16


def run_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` bytes; equal runs have equal hashes wherever they stand."""
    n = max(0, len(data) - size + 1)
    if n <= 1 << PART_BITS:
        return _run_hashes(data, size)
    out = np.empty(n, np.uint64)
    for at in range(0, n, 1 << PART_BITS):
        end = min(n, at + (1 << PART_BITS))
        out[at:end] = _run_hashes(data[at : end + size - 1], size)
    return out


def _run_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """The same of one part, by doubling."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, width = None, 0
    piece, piece_width = data.astype(np.uint64) + np.uint64(1), 1
    power = np.array([0x9E3779B97F4A7C55], np.uint64)  # of piece_width; arrays wrap around silently
    left = size
    while left:
        if left & 1:
            if out is None:
                out, width = piece, piece_width
            else:
                m = len(data) - width - piece_width + 1
                out = out[:m] * power + piece[width : width + m]
                width += piece_width
        left >>= 1
        if left:
            m = len(piece) - piece_width
            piece = piece[:m] * power + piece[piece_width : piece_width + m]
            piece_width *= 2
            power = power * power
    return mix64(out[:n])


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest value (by all but PART_BITS of its bits; the leftmost of equals) in every window of `width` values, 2^PART_BITS of them at most."""
    low = np.uint64((1 << PART_BITS) - 1)
    best = values & ~low | np.arange(len(values), dtype=np.uint64)
    done = 1
    while done < width:
        step = min(done, width - done)
        best = np.minimum(best[: len(best) - step], best[step:])
        done += step
    return (best & low).astype(np.int64)


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end byte, minimiser hash) of the runs of windows that share a minimiser's place."""
    n, width = len(data) - length + 1, length - GRAM + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    part = (1 << PART_BITS) - width + 1
    place, gram = [], []
    for at in range(0, n, part):  # of every window, also those that cross documents
        grams = run_hashes(data[at : min(n, at + part) + length - 1], GRAM)
        own = sliding_argmin(grams, width)
        place.append(own + at)
        gram.append(grams[own])
    place, gram = np.concatenate(place), np.concatenate(gram)
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    fresh = np.append(True, place[1:] != place[:-1])
    inside = np.repeat(np.tile([True, False], len(sizes)), np.stack([sizes, np.diff(offsets) - sizes], axis=1).ravel())[:n]
    fresh[offsets[:-1][sizes > 0]] = True
    fresh &= inside
    first = np.flatnonzero(fresh)
    rows = np.searchsorted(offsets, first, side="right") - 1
    ends = np.append(first[1:], n)
    stop = np.minimum(ends, (offsets[:-1] + sizes)[rows])  # one beyond the last window
    return rows, first, stop - 1 + length, gram[first]


def gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of these begins and sizes, one after the other."""
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, data.dtype)
    at = 0
    while at < len(size):  # parts that stay in the cache
        start = int(ends[at] - size[at])
        to = max(at + 1, int(np.searchsorted(ends, start + (1 << PART_BITS), side="right")))
        own = ends[at:to] - size[at:to] - start
        out[start : ends[to - 1]] = data[np.arange(int(ends[to - 1]) - start) + np.repeat(begin[at:to] - own, size[at:to])]
        at = to
    return out


class Pieces:
    """Segments as (owner, offset in the owner's text, length) with their bytes one after the other."""

    def __init__(self, owner: np.ndarray, at: np.ndarray, size: np.ndarray, data: np.ndarray):
        self.owner, self.at, self.size, self.data = owner, at, size, data
        self.begin = np.cumsum(size) - size

    def names(self) -> np.ndarray:
        """A 64-bit hash of each segment's bytes."""
        power = powers(int(self.size.max(initial=1)))
        sums = np.empty(len(self.size), np.uint64)
        ends = self.begin + self.size
        at = 0
        while at < len(sums):  # parts that stay in the cache
            to = max(at + 1, int(np.searchsorted(ends, self.begin[at] + (1 << PART_BITS), side="right")))
            begin, size = self.begin[at:to] - self.begin[at], self.size[at:to]
            letters = self.data[self.begin[at] : ends[to - 1]] + np.uint64(1)
            letters *= power[np.arange(len(letters)) - np.repeat(begin, size)]
            sums[at:to] = np.add.reduceat(letters, begin)
            at = to
        return mix64(sums + self.size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def take(self, which: np.ndarray) -> Pieces:
        return Pieces(self.owner[which], self.at[which], self.size[which], gathered(self.data, self.begin[which], self.size[which]))

    def between(self, first: int, end: int) -> Pieces:
        """A run of the segments, without a copy."""
        stop = self.begin[end - 1] + self.size[end - 1] if end > first else 0
        return Pieces(self.owner[first:end], self.at[first:end], self.size[first:end], self.data[self.begin[first] : stop] if end > first else self.data[:0])

    def blob(self) -> bytes:
        names, index = np.unique(self.owner, return_inverse=True)
        head = np.array([len(names), len(self.owner)], np.int64).tobytes()
        steps = np.diff(self.at, prepend=0)  # segments follow their documents
        body = names.tobytes() + steps.tobytes() + index.astype(np.uint32).tobytes() + self.size.astype(np.uint32).tobytes() + self.data.tobytes()
        return zstandard.ZstdCompressor(level=3).compress(head + body)

    @staticmethod
    def parse(blobs: list[pa.Buffer]) -> Pieces:
        parts: tuple[list, list, list, list] = ([], [], [], [])
        codec = zstandard.ZstdDecompressor()
        for packed in blobs:
            blob = codec.decompress(packed)
            k, n = np.frombuffer(blob, np.int64, 2).tolist()
            names = np.frombuffer(blob, np.int64, k, 16)
            at = 16 + 8 * k
            parts[0].append(names[np.frombuffer(blob, np.uint32, n, at + 8 * n)])
            parts[1].append(np.cumsum(np.frombuffer(blob, np.int64, n, at)))
            parts[2].append(np.frombuffer(blob, np.uint32, n, at + 12 * n).astype(np.int64))
            parts[3].append(np.frombuffer(blob, np.uint8, -1, at + 16 * n))
        return Pieces(*(np.concatenate(p) for p in parts))


class Seen:
    """The owners of segments that a task has shipped: a table of fixed size, in which newer ones replace older ones."""

    def __init__(self, bits: int = 20):
        self.mask = np.uint64((1 << bits) - 1)
        self.names, self.owners = np.zeros(1 << bits, np.uint64), np.full(1 << bits, NO_ID)

    def smaller(self, names: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Whether a segment of that name has been shipped for a smaller owner; remembers the others."""
        slot = (names & self.mask).astype(np.int64)
        known = self.names[slot] == names
        out = known & (self.owners[slot] < owners)
        new = ~out
        self.names[slot[new]], self.owners[slot[new]] = names[new], owners[new]
        return out


def distinct(pieces: Pieces, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each segment, the segment of smallest owner and place of each class)."""
    order = np.lexsort((pieces.at, pieces.owner, names))
    fresh = np.append(True, names[order][1:] != names[order][:-1])
    classes = np.empty(len(order), np.int64)
    classes[order] = np.cumsum(fresh) - 1
    return classes, order[fresh]


def suffix_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the suffixes data[starts:ends] in order, and each one's common prefix with the one before it."""
    if not len(starts):
        return starts, starts
    longest = int((ends - starts).max())
    wide = -(-longest // 8) * 8
    padded = np.concatenate([data, np.zeros(wide, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, wide)[starts].copy()
    beyond = np.arange(wide) >= (ends - starts)[:, None]
    rows[beyond] = 0
    words = rows.view(">u8").astype(np.uint64)
    order = np.lexsort((ends - starts, *words.T[::-1]))
    rows = rows[order]
    size = (ends - starts)[order]
    differ = rows[1:] != rows[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    lcp = np.concatenate([[0], np.minimum(same, np.minimum(size[1:], size[:-1]))])
    return order, lcp


def maximal_repeats(lcp: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, end) of every interval of depth >= least whose suffixes have different left neighbours.

    A stack scan of the common prefixes visits the intervals bottom up. left numbers each suffix's left
    neighbour; a suffix without one has a number of its own, so it differs from all others.
    """
    stack: list[list[int]] = []  # depth, first, left neighbour or -1 for several
    n = len(lcp)
    heights = lcp.tolist() + [0]
    lefts = left.tolist()
    for i in range(1, n + 1):
        height = heights[i] if heights[i] >= least else 0
        first, seen = i - 1, lefts[i - 1]
        while stack and stack[-1][0] > height:
            depth, begin, known = stack.pop()
            known = known if known == seen else -1
            if known == -1:
                yield depth, begin, i
            first, seen = begin, known
        if height:
            if stack and stack[-1][0] == height:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == seen else -1
            else:
                stack.append([height, first, seen])


def occurring_again(values: np.ndarray) -> np.ndarray:
    """Whether each value stands more than once in the array."""
    ordered = np.sort(values)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(values), bool)
    twice = twice[np.append(True, twice[1:] != twice[:-1])]
    mask = np.uint64((1 << 21) - 1)
    known = np.zeros(1 << 21, bool)
    known[twice & mask] = True
    out = known[values & mask]
    maybe = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(twice, values[maybe]), len(twice) - 1)
    out[maybe] = twice[place] == values[maybe]
    return out


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for size[0] numbers, and so on."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(first, size)


def bucket_repeats(pieces: Pieces, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, depth, owner, place) of every occurrence of each maximal repeat group of a bucket, by group."""
    classes, heads = distinct(pieces, pieces.names())
    firsts = pieces.take(heads)
    members = np.argsort(classes, kind="stable")
    copies = np.bincount(classes, minlength=len(heads))
    bounds = np.cumsum(copies) - copies
    n_windows = firsts.size - length + 1
    owner_class = np.repeat(np.arange(len(heads)), n_windows)
    starts = ranges(firsts.begin, n_windows)
    met = occurring_again(run_hashes(firsts.data, length)[starts])
    met_class = np.zeros(len(heads), bool)
    met_class[owner_class[met]] = True
    # a class of several segments is a group of itself; the tree has the groups of several classes
    several = np.flatnonzero(copies > 1)
    rank, lcp = suffix_array(firsts.data, starts[met], (firsts.begin + firsts.size)[owner_class[met]])
    at, cls = starts[met][rank], owner_class[met][rank]
    left = np.where(at > firsts.begin[cls], firsts.data[np.maximum(at - 1, 0)].astype(np.int64), 256 + np.arange(len(at)))
    found = np.array(list(maximal_repeats(lcp, left, length)) if len(rank) else [], np.int64).reshape(-1, 3)
    size = found[:, 2] - found[:, 1]
    suffix = ranges(found[:, 1], size)
    group_class = np.concatenate([several, cls[suffix]])
    shift = np.concatenate([np.zeros(len(several), np.int64), at[suffix] - firsts.begin[cls[suffix]]])
    group = np.concatenate([np.arange(len(several)), len(several) + np.repeat(np.arange(len(found)), size)])
    depth = np.concatenate([firsts.size[several], np.repeat(found[:, 0], size)])
    each = copies[group_class]
    who = members[ranges(bounds[group_class], each)]
    return np.repeat(group, each), np.repeat(depth, each), pieces.owner[who], pieces.at[who] + np.repeat(shift, each)


def later_occurrences(group: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Occurrences in other documents than the smallest of their group."""
    if not len(group):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    smallest = np.minimum.reduceat(owner, first)
    return owner > np.repeat(smallest, np.diff(np.append(first, len(group))))


def merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and adjoining spans of each document as one."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    if not len(doc):
        return doc, begin, end
    change = np.append(True, doc[1:] != doc[:-1])
    # ends made to ascend over documents, so that one running maximum serves them all
    shift = (np.cumsum(change) - 1) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    fresh = np.append(True, (begin + shift)[1:] > reach[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], begin[first], (reach - shift)[last]


def repeated_spans(texts: DataFrame, length: int, buckets: int, parts: int) -> DataFrame:
    """(part, blob): packed spans of the (doc, text) rows that occur in a smaller document, by part of the documents."""
    schema = "bucket int, blob binary, part int"
    names = ["bucket", "blob", "part"]

    def packed(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[list[int], list[bytes]]:
        doc, begin, end = merged(doc, begin, end)
        part = (mix64(doc.view(np.uint64).copy()) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        found, at = np.unique(part[order], return_index=True)
        codec = zstandard.ZstdCompressor(level=1)
        blobs = [codec.compress(np.concatenate([doc[w], begin[w], end[w] - begin[w]]).tobytes()) for w in (order[i:j] for i, j in zip(at, np.append(at[1:], len(order))))]
        return found.tolist(), blobs

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            owners = batch.column(0).to_numpy()
            for row, _, data, offsets in text_slices(batch.column(1), 3 << 20):
                for (data, offsets), shift in _windows_of(data, offsets, length):
                    rows, begin, stop, gram = segments(data, offsets, length)
                    if not len(rows):
                        continue
                    size = stop - begin
                    pieces = Pieces(owners[row + rows], begin - offsets[rows] + shift, size, gathered(data, begin, size))
                    named = pieces.names()
                    classes, heads = distinct(pieces, named)
                    smallest = pieces.owner[heads][classes]
                    later = pieces.owner > smallest
                    later |= seen.smaller(named[heads], pieces.owner[heads])[classes]
                    part, blobs = packed(pieces.owner[later], pieces.at[later], pieces.at[later] + pieces.size[later])
                    if part:
                        yield pa.RecordBatch.from_arrays([pa.array(np.resize(gram[:1] % np.uint64(buckets), len(part)).astype(np.int32)), pa.array(blobs, pa.binary()), pa.array(part, pa.int32())], names)
                    # the smallest document's segments stand for the others of the flush, whose spans are settled; so are
                    # those of segments that the task has shipped before for a smaller one
                    keep = np.flatnonzero(~later)
                    bucket = (gram[keep] % np.uint64(buckets)).astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    found, at = np.unique(bucket[order], return_index=True)
                    dealt = pieces.take(keep[order])
                    blobs = [dealt.between(i, j).blob() for i, j in zip(at, np.append(at[1:], len(order)))]
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(len(found), pa.int32())], names)

    def scan(table: pa.Table) -> pa.Table:
        ready = table.filter(table.column("part").is_valid())
        part, blobs = ready.column("part").to_pylist(), ready.column("blob").to_pylist()
        waiting = [x.as_buffer() for x in table.filter(table.column("part").is_null()).column("blob")]
        if waiting:
            group, depth, owner, at = bucket_repeats(Pieces.parse(waiting), length)
            later = later_occurrences(group, owner)
            more = packed(owner[later], at[later], (at + depth)[later])
            part, blobs = part + more[0], blobs + more[1]
        return pa.table({"part": pa.array(part, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return texts.mapInArrow(deal, schema).repartition(buckets // 4 + 1, "bucket").groupBy("bucket").applyInArrow(scan, "part int, blob binary")


def _windows_of(data: np.ndarray, offsets: np.ndarray, length: int, limit: int = 1 << 22) -> Iterator[tuple[tuple[np.ndarray, np.ndarray], int]]:
    """The slice itself, or a single long text in parts that overlap by length - 1 bytes: ((bytes, offsets), first byte)."""
    if len(offsets) > 2 or len(data) <= limit:
        yield (data, offsets), 0
        return
    for begin in range(0, max(1, len(data) - length + 1), limit):
        part = data[begin : begin + limit + length - 1]
        yield (part, np.array([0, len(part)])), begin


def remove_repeats(docs: DataFrame, *, length: int = 50, bucket_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text's bytes without its repeated spans."""
    spark = docs.sparkSession
    ship(spark)
    whole = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("doc"), whole.alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, parts = max(1, -(-3 * total // bucket_bytes)), max(1, -(-total // bucket_bytes))
    spans = repeated_spans(texts, length, buckets, parts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            part = (mix64(batch.column(0).to_numpy().view(np.uint64).copy()) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            found, at = np.unique(part[order], return_index=True)
            for p, i, j in zip(found, at, np.append(at[1:], len(order))):
                rows = pa.record_batch(batch.take(pa.array(order[i:j])).columns, ["doc", "text"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as writer:
                    writer.write_batch(rows)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([codec.compress(sink.getvalue())], pa.binary())], ["part", "blob"])

    def cut(rows: pa.Table, given: pa.Table) -> pa.Table:
        codec = zstandard.ZstdDecompressor()
        parsed = [np.frombuffer(codec.decompress(x.as_buffer()), np.int64).reshape(3, -1) for x in given.column("blob")]
        doc, begin, size = np.concatenate(parsed, axis=1) if parsed else np.empty((3, 0), np.int64)
        doc, begin, end = merged(doc, begin, begin + size)
        out: tuple[list, ...] = ([], [], [], [], [])
        held = (pa.ipc.open_stream(codec.decompress(x.as_buffer())).read_all() for x in rows.column("blob"))
        for name, text in ((n, t) for t_ in held for n, t in zip(t_.column("doc").to_pylist(), t_.column("text"))):
            raw = text.as_buffer() or b""
            a, b = np.searchsorted(doc, [name, name], side="left")[0], np.searchsorted(doc, name, side="right")
            starts, stops = np.minimum(begin[a:b], len(raw)), np.minimum(end[a:b], len(raw))
            view = memoryview(raw)
            for column, x in zip(out, (None if name == NO_ID else name, len(raw), int((stops - starts).sum()), len(starts), b"".join(view[i:j] for i, j in zip([0, *stops], [*starts, len(raw)])))):
                column.append(x)
        types = [pa.int64()] * 4 + [pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    tasks = parts // 4 + 1
    placed, spans = texts.mapInArrow(place, "part int, blob binary").repartition(tasks, "part"), spans.repartition(tasks, "part")
    return placed.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""Shared folders, materialised tables and byte kernels of the corpus operators."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybreak.session import ship as ship_package, table  # noqa: F401
from daybreak.tables import remove, scratch, shared_root, stored  # noqa: F401

#: Bytes of a batch that goes to a Python worker, so that long texts don't make large ones.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Makes the package importable on the executors and bounds the batches that go to them by bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(prefix: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case of its letters."""
    taken = {c.lower() for df in frames for c in df.columns}
    return next(name for k in itertools.count() if (name := f"{prefix}_{k}").lower() not in taken)


def filter_bits(count: int) -> int:
    """Bits of a filter over so many ids, as a power of two: 16 for each, 2^28 (32 MB) at most, where it lets more others through."""
    return min(28, max(16, int(16 * count).bit_length()))


def bitset(ids: DataFrame, bits: int) -> np.ndarray:
    """A filter of 2^bits bits over the 64-bit column id."""
    place = F.col("id").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    bit = F.expr("shiftleft(1L, cast(place & 63L AS INT))")
    words = ids.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return out


def in_bitset(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    place = ids.view(np.uint64) & np.uint64(64 * len(bits) - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


# ---- Arrow text columns as flat byte arrays ---------------------------------------------------


def text_slices(column: pa.Array, max_bytes: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a string column of about max_bytes: (first row, end row, bytes, offsets from 0); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + max_bytes, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(seed * 1_000_003 + 1, seed * 1_000_003 + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


POWER = np.uint64(0x9E3779B97F4A7C55)


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), POWER, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def place_keys(n: int) -> np.ndarray:
    """A multiplier for each place of a word: unrelated ones, as powers of one number give words like abba... and baab... the same sum modulo 2^64."""
    return odd_multipliers(max(n, 1), 41)


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each document in order, and the number of words of each document.

    is_word and fold are 256-entry tables over bytes: which bytes words are made of, and what
    each byte counts as. Words never cross documents.
    """
    docs = len(offsets) - 1
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(docs, np.int64)
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return np.empty(0, np.uint64), np.zeros(docs, np.int64)
    letters = fold[data[inside]].astype(np.uint64) + np.uint64(1)
    at = np.flatnonzero(first[inside])
    lengths = np.diff(np.append(at, len(letters)))
    place = np.arange(len(letters)) - np.repeat(at, lengths)
    letters *= place_keys(int(lengths.max()))[place]
    hashes = mix64(np.add.reduceat(letters, at) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    counts = np.diff(np.searchsorted(starts, offsets, side="left"))
    return hashes, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's runs of `size` words (fewer words: the whole sequence as one) and their number."""
    n_shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    if len(words) == 0:
        return np.empty(0, np.uint64), n_shingles
    factors = odd_multipliers(size, 77)
    padded = np.concatenate([words, np.zeros(size - 1, np.uint64)])
    mixed = padded[: len(words)] * factors[0]
    for j in range(1, size):
        mixed += padded[j : j + len(words)] * factors[j]
    ends = np.cumsum(counts)
    begins = ends - counts
    place = np.arange(len(words)) - np.repeat(begins, counts)
    keep = place < np.repeat(n_shingles, counts)
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        short = words[begins[d] : ends[d]]
        mixed[begins[d]] = (short * factors[: len(short)]).sum(dtype=np.uint64) + np.uint64(len(short))
    return mix64(mixed[keep]), n_shingles


def sorted_sets(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row in ascending order, one row after the other, and their number; sorts in place."""
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        hashes[a:b].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    keep[(ends - counts)[counts > 0]] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    return hashes[keep], upto[ends] - upto[ends - counts]


def row_views(flat: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(counts).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def table_of(chars: bytes, complement: bool = False) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return ~out if complement else out


IDENTITY = np.arange(256, dtype=np.uint8)
LOWER_AZ = IDENTITY.copy()
LOWER_AZ[65:91] += 32
#: Bytes of words as runs of anything but space and U+0009 to U+000D.
NOT_SPACE = table_of(b" \t\n\x0b\x0c\r", complement=True)
#: Bytes of words as runs of ASCII letters and digits and of every non-ASCII byte.
ALNUM = table_of(bytes(i for i in range(256) if i >= 128 or chr(i).isalnum()))


def binary_rows(flat: np.ndarray, row_items: np.ndarray) -> pa.Array:
    """A binary column whose rows are consecutive runs of row_items elements of flat."""
    offsets = np.zeros(len(row_items) + 1, np.int64)
    np.cumsum(row_items * flat.dtype.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(row_items), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())

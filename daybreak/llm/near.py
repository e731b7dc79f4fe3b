"""MinHash postings, merged into counted candidate pairs, and links that are found without pairing off a group.

Postings (a 64-bit key, a row id and a sketch of the coordinates that aren't posted) travel as packed arrays, one
blob for each bucket of keys and flush. A bucket merges its posting lists, runs of equal keys: a run of at most
`SHORT` members gives its pairs, each with the number of lists of the bucket in which it collides, and with the
coordinates of the sketches that agree (the skipped lists, probed). These counts are summed over the buckets. A longer
run gives its members only; what two ids may share in long runs, at most the number of long runs that the lesser of
them is in, is added to their count before it is held against the threshold, so no pair is lost by it.

A key with many postings in one flush (`LOCAL`) doesn't reach its bucket: its members go on as those of a long run, and
a marker tells the bucket. So what one task holds of a key is bounded by `LOCAL` for each flush.

A long run is settled by stars first: of the run around its most central member (that with the most company over all long
runs), and of splits of about `SPLIT` members around the most central one of each. First one star a member and the
stars of the short runs are confirmed and united; then what still joins different components of the short runs' other
pairs, the other runs' stars and the splits' stars. A group of n near copies costs about n confirmations, then.
What of a long run is in different components still is compared pair by pair (`Rest`), on marks that leave out no link, and
what the marks let through is confirmed: where it is much, first one pair for each two components, then all pairs of those that it didn't join.
So every two ids that meet in a run are joined or refuted. That step is quadratic in a run's ids outside its hub's component,
times its ids; it is cut into tiles of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybreak.llm.common import mix64, odd_multipliers, remove, row_views, stored
from daybreak.llm.graph import connected_components

#: A run of at most this many members gives all its pairs.
SHORT = 16
#: Members of a split of a long run, about.
SPLIT = 32
#: Ids of a tile of a long run, of which all pairs are compared at once.
TILE = 1024
#: Possible links for each id of two tiles up to which all are confirmed at once.
FEW = 4
#: Postings of one key in a flush beyond which they are a long run's.
LOCAL = 128
#: Postings of a flush: as many buckets as there may be, a row holds a few kilobytes at most where rows are kept in Parquet.
FLUSH = 1 << 18
MARK = np.int64(-(1 << 63))


def minhash(hashes: np.ndarray, counts: np.ndarray, permutations: int, seed: int = 1) -> np.ndarray:
    """(rows, permutations) minima over each row's hashes; every row must have one at least."""
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), permutations), np.uint64)
    block = 1 << 15
    factors = odd_multipliers(permutations, seed)
    row = 0
    while row < len(counts):  # blocks that stay in the processor's cache
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + block, side="right")) - 1)
        part = hashes[starts[row] : starts[end] if end < len(counts) else len(hashes)]
        at = starts[row:end] - starts[row]
        for k, factor in enumerate(factors):
            out[row:end, k] = np.minimum.reduceat((part * factor) >> np.uint64(1), at)
        row = end
    return out


def folded(minima: np.ndarray, rows: int) -> np.ndarray:
    """Coordinates of `rows` minima each, told apart by their place: 64-bit keys of shape (n, permutations // rows)."""
    n, k = minima.shape
    groups = minima.reshape(n, k // rows, rows)
    factors = odd_multipliers(rows, 5)
    return mix64((groups * factors).sum(axis=2, dtype=np.uint64) + np.arange(k // rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


#: Up to five coordinates of so many bits, below the size class of a set.
SKETCH_BITS, SKETCHED = 11, 5
#: Sizes of a class are within this factor.
SIZE_STEP = 1.06
#: Classes on either side of its own that a set of similarity 0.8 may be in.
SIZE_REACH = 4


def sketches(coordinates: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The coordinates and the size class of each set in a number."""
    classes = np.minimum(np.log(np.maximum(sizes, 1)) / np.log(SIZE_STEP), 511).astype(np.uint64)
    out = classes << np.uint64(SKETCH_BITS * SKETCHED)
    for j in range(coordinates.shape[1]):
        out |= (coordinates[:, j] & np.uint64((1 << SKETCH_BITS) - 1)) << np.uint64(j * SKETCH_BITS)
    return out


def agreeing(a: np.ndarray, b: np.ndarray, skipped: int) -> np.ndarray:
    """How many of `skipped` sketched coordinates agree."""
    differ = a ^ b
    out = np.zeros(len(a), np.int32)
    for j in range(skipped):
        out += (differ >> np.uint64(j * SKETCH_BITS)) & np.uint64((1 << SKETCH_BITS) - 1) == 0
    return out


def size_classes(sketch: np.ndarray) -> np.ndarray:
    return (sketch >> np.uint64(SKETCH_BITS * SKETCHED)).astype(np.int32)


class Postings:
    """Gathers postings and emits them as (bucket, blob) rows.

    Of a key, the 32 bits below the bucket's stand for it, which makes about one in four thousand postings meet a
    stranger at any size, as a bucket's postings are bounded; their links are refuted by the confirmation. Long runs
    go out in groups of their own, which have negative numbers.
    """

    NAMES = ["bucket", "blob"]
    SCHEMA = "bucket long, blob binary"

    def __init__(self, bucket_bits: int, sketched: bool = False):
        self.bits, self.sketched, self.keys, self.ids, self.sketches, self.held = bucket_bits, sketched, [], [], [], 0
        context = TaskContext.get()
        self.place, self.flushes = context.partitionId() if context else 0, 0

    def add(self, keys: np.ndarray, ids: np.ndarray, sketch: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if keys.size:
            self.keys.append(keys.ravel())
            self.ids.append(np.repeat(ids.astype(np.int64), keys.shape[1]))
            if self.sketched:
                self.sketches.append(np.repeat(sketch, keys.shape[1]))
            self.held += keys.size
            if self.held >= FLUSH:
                yield self.flush()

    def flush(self) -> pa.RecordBatch:
        buckets, blobs = [], []
        if self.held:
            keys, ids = np.concatenate(self.keys), np.concatenate(self.ids)
            sketch = np.concatenate(self.sketches) if self.sketched else np.empty(0, np.uint64)
            ordered = np.sort(keys)
            hot = np.unique(ordered[LOCAL:][ordered[LOCAL:] == ordered[:-LOCAL]])
            if len(hot):
                long = np.isin(keys, hot)
                order = np.flatnonzero(long)
                order = order[np.argsort(keys[order], kind="stable")]
                buckets.append(-1 - (self.place << 20 | self.flushes))
                blobs.append(ids[order].tobytes() + keys[order].tobytes() + (sketch[order].tobytes() if self.sketched else b""))
                keys, ids = np.append(keys[~long], hot), np.append(ids[~long], np.full(len(hot), MARK))
                sketch = np.append(sketch[~long], np.zeros(len(hot), np.uint64)) if self.sketched else sketch
            bucket = (keys >> np.uint64(64 - self.bits)).astype(np.uint16 if self.bits <= 16 else np.uint32) if self.bits else np.zeros(len(keys), np.uint16)
            order = np.argsort(bucket, kind="stable")
            bucket, ids, sketch = bucket[order], ids[order], sketch[order] if self.sketched else sketch
            short = (keys[order] << np.uint64(self.bits) >> np.uint64(32)).astype(np.uint32)
            at = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist()
            for i, j in zip(at, at[1:]):
                buckets.append(int(bucket[i]))
                blobs.append(ids[i:j].tobytes() + short[i:j].tobytes() + sketch[i:j].tobytes())
        self.keys, self.ids, self.sketches, self.held = [], [], [], 0
        self.flushes += 1
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(blobs, pa.binary())], self.NAMES)


def bucket_bits(postings: int, each: int = 1 << 20) -> int:
    """Enough buckets for about `each` postings in one."""
    return max(0, int(np.ceil(np.log2(max(1, postings / each)))))


STAR, REST, RUN = 0, 1, 2
FOUND = "kind byte, a long, b long, n int, skipped int"
_NO_PAIRS = (np.empty(0, np.int64),) * 2 + (np.empty(0, np.int32),) * 2


def _found(kind: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, skipped: np.ndarray) -> pa.Table:
    return pa.table({"kind": pa.array(kind, pa.int8()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int32()), "skipped": pa.array(skipped, pa.int32())})


def merged_lists(table: pa.Table, bits: int, skipped: int) -> pa.Table:
    """One bucket's FOUND rows: pairs of short runs with their collisions, and (key, member, run's size, size class) of long runs."""
    bucket = table.column("bucket")[0].as_py()
    keys, ids, sketch = [], [], []
    for blob in table.column("blob"):
        data = blob.as_buffer()
        if bucket < 0:
            n = len(data) // (24 if skipped else 16)
            ids.append(np.frombuffer(data, np.int64, n))
            keys.append(np.frombuffer(data, np.uint64, n, 8 * n))
            if skipped:
                sketch.append(np.frombuffer(data, np.uint64, n, 16 * n))
            continue
        n = len(data) // (20 if skipped else 12)
        ids.append(np.frombuffer(data, np.int64, n))
        keys.append(np.frombuffer(data, np.uint32, n, 8 * n))
        if skipped:
            sketch.append(np.frombuffer(data, np.uint64, n, 12 * n))
    keys, ids = np.concatenate(keys), np.concatenate(ids)
    sketch = np.concatenate(sketch) if skipped else np.zeros(len(keys), np.uint64)
    if bucket < 0:
        keys = keys.copy()
        if bits:
            low = keys << np.uint64(bits) >> np.uint64(32)
            keys = (keys >> np.uint64(64 - bits) << np.uint64(32)) | low
        else:
            keys >>= np.uint64(32)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(first, len(keys)))
        return _found(np.full(len(keys), RUN), keys.view(np.int64), ids, np.repeat(sizes, sizes), size_classes(sketch))
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    known = np.zeros(1 << 20, bool)
    known[twice & np.uint32((1 << 20) - 1)] = True  # lets few others through, which the runs below leave out
    some = np.flatnonzero(known[keys & np.uint32((1 << 20) - 1)])
    order = some[np.lexsort((ids[some], keys[some]))]
    keys, ids, sketch = keys[order], ids[order], sketch[order]
    fresh = np.append(True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])) if len(keys) else np.zeros(0, bool)
    keys, ids, sketch = keys[fresh], ids[fresh], sketch[fresh]
    if not len(keys):
        return _found(*(np.empty(0, np.int8),), *_NO_PAIRS)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(first, len(keys)))
    marked = ids[first] == MARK  # the smallest of its run
    size = np.repeat(sizes, sizes)
    long = np.repeat(marked | (sizes > SHORT), sizes) & (ids != MARK)
    short = ~np.repeat(marked | (sizes > SHORT), sizes) & (size > 1)
    place = np.arange(len(keys)) - np.repeat(first, sizes)
    left, right, star = [], [], []
    for d in range(1, SHORT):
        at = np.flatnonzero(short & (place >= d))
        if not len(at):
            break
        left.append(at - d)
        right.append(at)
        star.append(place[at] == d)  # with the run's first
    a, b, n, agree, kind = *_NO_PAIRS, np.empty(0, np.int8)
    if left:
        left, right, star = np.concatenate(left), np.concatenate(right), np.concatenate(star)
        order = np.lexsort((~star, ids[right], ids[left]))
        left, right, star = left[order], right[order], star[order]
        a, b = ids[left], ids[right]
        head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        n = np.diff(np.append(head, len(a)))
        agree = agreeing(sketch[left[head]], sketch[right[head]], skipped)
        kind = np.where(star[head], STAR, REST)
        a, b = a[head], b[head]
    runs = (np.uint64(bucket) << np.uint64(32) | keys[long]).astype(np.uint64).view(np.int64)
    return _found(np.append(kind, np.full(len(runs), RUN)), np.append(a, runs), np.append(b, ids[long]), np.append(n, size[long]), np.append(agree, size_classes(sketch[long])))


def found_pairs(postings: DataFrame, label: str, bits: int, tasks: int, skipped: int = 0) -> DataFrame:
    """The stored FOUND rows of postings in 2^bits buckets; tasks grows with the postings."""
    def of(table: pa.Table) -> pa.Table:
        return merged_lists(table, bits, skipped)

    return stored(postings.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(of, FOUND), label)


class Candidates:
    """Counted pairs of short runs and the stars of long ones, over a table of FOUND rows."""

    def __init__(self, found: DataFrame, matches: int = 1):
        runs = found.where(F.col("kind") == RUN).groupBy(F.col("a").alias("key"), F.col("b").alias("id")).agg(F.max("n").alias("n"), F.max("skipped").alias("size_class"))
        weights = runs.groupBy("id").agg(F.sum("n").alias("weight"), F.count("*").cast("int").alias("long_runs"))
        heavy = runs.join(weights, "id").select("key", "id", "weight", "size_class")
        hubs = heavy.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("other"))).alias("top"), F.count("*").alias("size"))
        hubs = hubs.select(F.col("key").alias("hub_key"), (-F.col("top.other")).alias("hub"), F.col("top.weight").alias("hub_weight"), "size")
        salt = F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("size") / SPLIT))
        self.members = stored(heavy.join(hubs, F.col("key") == F.col("hub_key")).select("key", "id", "weight", "size_class", "hub", "hub_weight", salt.alias("salt")), "members")
        pairs = found.where(F.col("kind") != RUN).groupBy("a", "b").agg(F.min("kind").alias("kind"), F.sum("n").alias("n"), F.max("skipped").alias("skipped"))
        if matches > 1:
            of = lambda name: weights.select(F.col("id").alias(name), F.col("long_runs").alias(f"{name}_long"))
            pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
            most = F.least(F.coalesce("a_long", F.lit(0)), F.coalesce("b_long", F.lit(0)))
            pairs = pairs.where(F.col("n") + F.col("skipped") + most >= matches)
        self.pairs = stored(pairs.select("kind", "a", "b"), "pairs")

    def ids(self) -> DataFrame:
        """Every id that a pair or a long run has."""
        both = self.pairs.select(F.explode(F.array("a", "b")).alias("id"))
        return both.unionByName(self.members.select("id")).distinct()

    def first(self) -> DataFrame:
        """The stars of short runs, and of each member of long runs that around its most central hub."""
        best = self.members.where("id <> hub").groupBy("id").agg(F.max(F.struct("hub_weight", (-F.col("hub")).alias("other"))).alias("top"))
        return self.pairs.where(F.col("kind") == STAR).select("a", "b").unionByName(_ordered((-F.col("top.other")), F.col("id"), best)).distinct()

    def second(self) -> DataFrame:
        """The other pairs of short runs, all other hubs of long runs and the hubs of their splits."""
        splits = self.members.groupBy("key", "salt").agg(F.max(F.struct("weight", (-F.col("id")).alias("other"))).alias("top")).select("key", "salt", (-F.col("top.other")).alias("near"))
        near = self.members.join(splits, ["key", "salt"]).where("id <> near")
        hubs = self.members.where("id <> hub")
        return self.pairs.where(F.col("kind") == REST).select("a", "b").unionByName(_ordered(F.col("hub"), F.col("id"), hubs)).unionByName(_ordered(F.col("near"), F.col("id"), near)).distinct()

    def separate(self, roots: DataFrame) -> DataFrame:
        """(hub, id, root, hub_root, n) of the long runs of a hub that hold more than one component, each id once."""
        of = lambda name: roots.select(F.col("id").alias(name), F.col("root").alias(f"{name}_root"))
        met = self.members.select("hub", "id").distinct().join(of("id"), "id", "left").select("hub", "id", F.coalesce("id_root", "id").alias("root"))
        mixed = met.groupBy("hub").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.when(F.col("id") == F.col("hub"), F.col("root"))).alias("hub_root"))
        return met.join(mixed.where("low <> high").select("hub", "n", "hub_root"), "hub")

    def drop(self) -> None:
        remove(self.members, self.pairs)


def _ordered(x: Column, y: Column, rows: DataFrame) -> DataFrame:
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def shared_counts(ones: list[np.ndarray], twos: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, 256 pairs at most: all of them with one sort, by 56 bits of each hash and the pair's number."""
    sizes = np.fromiter(map(len, ones), np.int64, len(ones)) + np.fromiter(map(len, twos), np.int64, len(twos))
    flat = np.concatenate([x for pair in zip(ones, twos) for x in pair]) >> np.uint64(8)
    flat |= np.repeat(np.arange(len(ones), dtype=np.uint64) << np.uint64(56), sizes)
    flat.sort()
    return np.bincount((flat[1:][flat[1:] == flat[:-1]] >> np.uint64(56)).astype(np.int64), minlength=len(ones))


def similar(set_slices: Callable[[pa.Array], Iterator[tuple[int, int, np.ndarray, np.ndarray]]], percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps of (a, b, text of a, text of b) rows the pairs whose full sets have 100 * intersection >= percent * union."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        weight = 0

        def learn(names: np.ndarray, column: pa.Array) -> None:
            nonlocal weight
            found, at = np.unique(names, return_index=True)
            new = [k for k, name in enumerate(found.tolist()) if name not in held]
            if new:
                order = found[new].tolist()
                for row, end, hashes, counts in set_slices(column.take(pa.array(at[new]))):
                    held.update(zip(order[row:end], row_views(hashes, counts)))
                    weight += len(hashes)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if weight > 1 << 22:
                    held.clear()
                    weight = 0
                a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
                learn(a, part.column(2))
                learn(b, part.column(3))
                ones, twos = [held[x] for x in a.tolist()], [held[x] for x in b.tolist()]
                one, two = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ones, twos))
                low, high = np.minimum(one, two), np.maximum(one, two)
                maybe = np.flatnonzero(100 * low >= percent * high)  # otherwise even one inside the other isn't enough
                keep = np.zeros(len(a), bool)
                if len(maybe):
                    shared = shared_counts([ones[k] for k in maybe], [twos[k] for k in maybe])
                    keep[maybe] = 100 * shared >= percent * (one + two)[maybe] - percent * shared
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], ["a", "b"])

    return kept


def marked(set_slices: Callable[[pa.Array], Iterator[tuple[int, int, np.ndarray, np.ndarray]]], bits: int, coordinates: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (id, text) rows (id, size, mark): 16 bits of each coordinate, and of each of `bits` places whether an odd number of the set's hashes falls there."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, hashes, counts in set_slices(batch.column(1)):
                ends = np.cumsum(counts)
                for at in range(0, len(counts), 256):
                    own = counts[at : at + 256]
                    part = hashes[ends[at] - counts[at] : ends[at + len(own) - 1]]
                    place = (np.repeat(np.arange(len(own)), own) * bits + (part & np.uint64(bits - 1)).astype(np.int64))
                    odd = np.packbits((np.bincount(place, minlength=len(own) * bits) & 1).astype(bool)).reshape(len(own), bits // 8)
                    if coordinates:
                        odd = np.concatenate([coordinates(part, own).astype("<u2").view(np.uint8), odd], axis=1)
                    names = batch.column(0).slice(row + at, len(own))
                    yield pa.RecordBatch.from_arrays([names, pa.array(own, pa.int64()), pa.array([r.tobytes() for r in odd], pa.binary())], ["id", "size", "mark"])

    return of


def _tile(cell: pa.StructScalar, coordinates: int) -> tuple[np.ndarray, ...]:
    rows = cell.values
    ids, roots, sizes = (rows.field(k).to_numpy() for k in range(3))
    marks = np.stack([np.frombuffer(m.as_buffer(), np.uint8) for m in rows.field(3)])
    shared, odd = np.ascontiguousarray(marks[:, : 2 * coordinates]).view("<u2"), np.ascontiguousarray(marks[:, 2 * coordinates :]).view(np.uint64)
    return ids, roots, sizes, shared, odd


def possible(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], same: bool, percent: int, matches: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs of two tiles that may be links between different components, and by how much their sets may differ still.

    Sets of a similarity of `percent` differ in at most (100 - percent) / (100 + percent) of the sum of their sizes, and in at
    least as many elements as there are places of which their marks say different things; so no link is left out by them.
    """
    _, roots_a, sizes_a, shared_a, odd_a = one
    _, roots_b, sizes_b, shared_b, odd_b = two
    most = (100 - percent) * (sizes_a[:, None] + sizes_b) // (100 + percent)
    maybe = (roots_a[:, None] != roots_b) & (np.abs(sizes_a[:, None] - sizes_b) <= most)
    if same:
        maybe = np.triu(maybe, 1)
    if shared_a.shape[1] and maybe.any():
        agree = np.zeros(maybe.shape, np.uint8)
        for k in range(shared_a.shape[1]):
            agree += shared_a[:, k, None] == shared_b[:, k]
        maybe &= agree >= matches
    left, right = np.nonzero(maybe)
    slack = most[left, right]
    for begin, end in ((0, 4), (4, odd_a.shape[1])):
        kept = []
        for at in range(0, len(left), 1 << 16):
            part = slice(at, at + (1 << 16))
            slack[part] -= np.bitwise_count(odd_a[left[part], begin:end] ^ odd_b[right[part], begin:end]).sum(axis=1, dtype=np.int64)
            kept.append(at + np.flatnonzero(slack[part] >= 0))
        keep = np.concatenate(kept) if kept else np.empty(0, np.int64)
        left, right, slack = left[keep], right[keep], slack[keep]
    return left, right, slack


class Rest:
    """Pairs of long runs that no star has settled: all that are in one run and in different components are held against each other's marks, by tiles."""

    def __init__(self, marks: Callable[[DataFrame], DataFrame], percent: int, coordinates: int = 0, matches: int = 0):
        self.marks, self.percent, self.coordinates, self.matches = marks, percent, coordinates, matches

    def pairs(self, separate: DataFrame, first: bool) -> DataFrame | None:
        """(a, b, more) of possible links; first: where two tiles have many, one for each two components, more where there are others.

        Runs of up to TILE ids are a tile. Larger ones are cut by size class and by whether an id is in the hub's component already, whose
        ids need no comparison with one another; a pair of tiles is a row, wherever it is dealt to.
        """
        held = stored(separate, "separate")
        if held.isEmpty():
            remove(held)
            return None
        full = stored(held.join(self.marks(held.select("id").distinct()), "id"), "marked")
        remove(held)
        big = F.col("n") > TILE
        cells = full.withColumn("cell", F.when(big, F.floor(F.log(F.greatest("size", F.lit(1))) / np.log(SIZE_STEP))).otherwise(0).cast("int")).withColumn("main", big & (F.col("root") == F.col("hub_root")))
        numbers = cells.groupBy("hub", "cell", "main").agg(F.count("*").alias("n_cell"))
        salted = cells.join(numbers, ["hub", "cell", "main"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("n_cell") / TILE)))
        tiles = stored(salted.groupBy("hub", "cell", "main", "salt").agg(F.collect_list(F.struct("id", "root", "size", "mark")).alias("rows")).withColumn("tile", F.monotonically_increasing_id()), "tiles")
        remove(full)
        head = lambda x: tiles.select("hub", F.col("tile").alias(x), F.col("cell").alias(f"{x}_cell"), F.col("main").alias(f"{x}_main"))
        met = head("one").join(head("two"), "hub").where(f"one <= two and abs(one_cell - two_cell) <= {SIZE_REACH} and not (one_main and two_main)").select("one", "two")
        body = lambda x: tiles.select(F.col("tile").alias(x), F.col("rows").alias(f"{x}_rows"))
        percent, coordinates, matches = self.percent, self.coordinates, self.matches

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    same = batch.column(0)[k].as_py() == batch.column(1)[k].as_py()
                    one = _tile(batch.column(2)[k], coordinates)
                    two = one if same else _tile(batch.column(3)[k], coordinates)
                    left, right, slack = possible(one, two, same, percent, matches)
                    more = np.zeros(len(left), bool)
                    if first and len(left) > FEW * (len(one[0]) + len(two[0])):
                        low, high = np.minimum(one[1][left], two[1][right]), np.maximum(one[1][left], two[1][right])
                        order = np.lexsort((-slack, high, low))
                        low, high = low[order], high[order]
                        head = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
                        more = np.diff(np.append(head, len(order))) > 1
                        left, right = left[order[head]], right[order[head]]
                    a, b = one[0][left], two[0][right]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(more)], ["a", "b", "more"])

        found = met.join(body("one"), "one").join(body("two"), "two").select("one", "two", "one_rows", "two_rows").mapInArrow(compare, "a long, b long, more boolean")
        out = stored(found.groupBy("a", "b").agg(F.max("more").alias("more")), "rest-pairs")
        remove(tiles)
        return out


def _united(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The roots after further confirmed links."""
    of = lambda name: roots.select(F.col("id").alias(name), F.col("root").alias(f"{name}_root"))
    named = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    above = connected_components(named)
    out = roots.join(above.select(F.col("id").alias("root"), F.col("root").alias("higher")), "root", "left").select("id", F.coalesce("higher", "root").alias("root"))
    alone = above.join(roots.select("id"), "id", "left_anti")
    return stored(out.unionByName(alone), "roots")


def linked(candidates: Candidates, confirm: Callable[[DataFrame], DataFrame], rest: Rest) -> DataFrame:
    """(id, root) of the ids that aren't the smallest of their component of confirmed links; confirm keeps the true links of (a, b) rows."""

    edges = stored(confirm(candidates.first()), "first-edges")
    roots = connected_components(edges)
    remove(edges)
    of = lambda name: roots.select(F.col("id").alias(name), F.col("root").alias(f"{name}_root"))
    ends = candidates.second().join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = ends.select("a", "b", F.coalesce("a_root", "a").alias("a_root"), F.coalesce("b_root", "b").alias("b_root")).where("a_root <> b_root")
    out = _united(roots, stored(confirm(ends.select("a", "b")), "second-edges"))
    for first in (True, False):  # one link for each two components, then whatever is still possible between those that it didn't join
        pairs = rest.pairs(candidates.separate(out), first)
        if pairs is None:
            break
        out = _united(out, stored(confirm(pairs.select("a", "b")), "rest-edges"))
        if pairs.where("more").isEmpty():
            break
    return out

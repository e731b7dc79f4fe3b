"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct runs of 3 to 7 characters of its lower-cased form, with line ends as
spaces and a space at either end, hashed into 2^20 places. Training takes a bounded sample of labelled rows (`sample_rows` and `sample_bytes`,
in the order of a hash of the id, at most two fifths of either toxic; a text that doesn't fit is left out), scales every
feature by the log ratio of its smoothed counts in both labels, drops features in fewer than
`least_rows` rows or of a smaller ratio than `least_ratio`, and fits a logistic regression with an L2 penalty on the scaled features. The
intercept is then moved to the share of toxic rows among all labelled training rows. Every whole text
is scored with the resulting weight vector, which has 4 MB at any size of the corpus.

Cases: a null or empty text has no features and gets the intercept's score; a row whose label is null
isn't trained on; an id with several labels counts as toxic if one says so; without labelled rows of
both kinds every score is the smoothed share of toxic rows (0 without any rows); extra columns are
ignored; a null id isn't held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybreak.llm.common import binary_rows, ship, stored, table

BITS = 20
#: Characters whose n-grams are hashed at a time: a longer text comes in parts.
PART = 1 << 17
SIZES = (3, 4, 5, 6, 7)
_stamps: dict[int, np.ndarray] = {}


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct hashed n-grams of each text."""
    stamp = _stamps.setdefault(BITS, np.zeros(1 << BITS, np.int32))
    held: list[str] = []
    size = 0
    for scalar in column:
        text = scalar.as_py()
        if text and len(text) > PART:
            yield from _features(held, stamp)
            held, size = [], 0
            yield _long_features(f" {text.lower()} ")
            continue
        held.append(f" {text.lower()} " if text else "")
        size += len(held[-1])
        if size >= PART:
            yield from _features(held, stamp)
            held, size = [], 0
    yield from _features(held, stamp)


def _long_features(text: str) -> np.ndarray:
    """The same of one long text, by parts that overlap by an n-gram."""
    known = np.zeros(1 << BITS, bool)
    for at in range(0, len(text), PART):
        part = text[at : at + PART + max(SIZES) - 1]
        for n, places in zip(SIZES, _places([part])):
            known[places[: max(0, len(part) - n + 1)]] = True
    return np.flatnonzero(known).astype(np.int32)


def _places(texts: list[str]) -> list[np.ndarray]:
    """For each size the hashed place of the n-gram that begins at each letter."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.where((letters >= 9) & (letters <= 13), np.uint32(32), letters)
    rolled, places = letters.copy(), []
    for j in range(1, max(SIZES)):
        rolled = rolled[:-1] * np.uint32(0x01000193) ^ letters[j:]
        if j + 1 in SIZES:
            mixed = rolled ^ np.uint32((j + 1) * 0x9E3779B1 & 0xFFFFFFFF)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x85EBCA77)
            mixed ^= mixed >> np.uint32(13)
            mixed *= np.uint32(0xC2B2AE3D)
            places.append((mixed >> np.uint32(32 - BITS)).astype(np.int32))
    return places


def _features(texts: list[str], stamp: np.ndarray) -> Iterator[np.ndarray]:
    places = _places(texts)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    for a, b in zip(offsets[:-1], offsets[1:]):
        found = np.concatenate([p[a : max(a, b - n + 1)] for n, p in zip(SIZES, places)])
        turn = np.arange(len(found), dtype=np.int32)
        stamp[found] = turn
        yield found[stamp[found] == turn]


class Model(NamedTuple):
    weights: np.ndarray
    intercept: float

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[found].sum(dtype=np.float64), -500, 500))))


def _minimise(value_and_slope, x: np.ndarray, steps: int = 60, memory: int = 8) -> np.ndarray:
    """L-BFGS with step halving."""
    value, slope = value_and_slope(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        direction = slope.copy()
        kept = []
        for s, y, rho in reversed(past):
            a = rho * s.dot(direction)
            kept.append(a)
            direction -= a * y
        if past:
            s, y, _ = past[-1]
            direction *= s.dot(y) / y.dot(y)
        for (s, y, rho), a in zip(past, reversed(kept)):
            direction += s * (a - rho * y.dot(direction))
        fall, step = slope.dot(direction), 1.0 if past else 1.0 / max(1.0, float(np.abs(slope).sum()))
        while True:
            moved = x - step * direction
            new_value, new_slope = value_and_slope(moved)
            if new_value <= value - 1e-4 * step * fall or step < 1e-10:
                break
            step /= 2
        s, y = moved - x, new_slope - slope
        if s.dot(y) > 1e-12:
            past = [*past, (s, y, 1 / s.dot(y))][-memory:]
        done = abs(value - new_value) < 1e-6 * max(1.0, abs(value))
        x, value, slope = moved, new_value, new_slope
        if done:
            break
    return x


def log_count_ratio(in_toxic: np.ndarray, in_clean: np.ndarray, n_toxic: float, n_clean: float, least_rows: int = 5, least_ratio: float = 1.0, smoothing: float = 1.0) -> np.ndarray:
    """The naive Bayes scale of every feature from the rows of either label that hold it; 0 drops the feature."""
    ratio = np.log((in_toxic + smoothing) / (n_toxic + 2 * smoothing)) - np.log((in_clean + smoothing) / (n_clean + 2 * smoothing))
    return np.where((in_toxic + in_clean < least_rows) | (np.abs(ratio) < least_ratio), 0, ratio).astype(np.float32)


def fit(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, share: float, penalty: float = 1.0) -> Model:
    """rows: each text's distinct features of a ratio other than 0. share: of toxic rows among all labelled rows."""
    n_toxic, n_clean = float((labels == 1).sum()), float((labels == 0).sum())
    flat, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, column = np.unique(flat, return_inverse=True)
    scale = ratio[used]
    values = scale[column]
    signs = np.where(labels == 1, 1.0, -1.0)

    def value_and_slope(x: np.ndarray) -> tuple[float, np.ndarray]:
        margin = signs * (np.bincount(row, values * x[:-1][column], len(rows)) + x[-1])
        pull = -signs / (1 + np.exp(np.clip(margin, -500, 500)))
        slope = np.append(np.bincount(column, values * pull[row], len(used)) + penalty * x[:-1], pull.sum())
        return float(np.logaddexp(0, -margin).sum() + penalty / 2 * x[:-1].dot(x[:-1])), slope

    best = _minimise(value_and_slope, np.zeros(len(used) + 1))
    weights = np.zeros(len(ratio), np.float32)
    weights[used] = best[:-1] * scale
    prior = np.log(share / (1 - share)) - np.log(n_toxic / n_clean)
    return Model(weights, float(best[-1] + prior))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, sample_bytes: int = 64 << 20) -> Model:
    """The model from labelled rows whose id isn't held out."""
    ship(docs.sparkSession)
    kept = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = kept.groupBy("doc_id").agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    flat = Model(np.zeros(1 << BITS, np.float32), float(np.log((n_toxic + 0.5) / (n_clean + 0.5))) if n_toxic + n_clean else -500.0)
    if not n_toxic or not n_clean:
        return flat
    order = F.xxhash64("doc_id")
    chosen = marked.where("toxic = 1").orderBy(order, "doc_id").limit(sample_rows * 2 // 5).unionByName(marked.where("toxic = 0").orderBy(order, "doc_id").limit(sample_rows * 3 // 5))
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max(F.octet_length("text")).alias("bytes"), order.alias("turn")).orderBy("turn", "doc_id").toPandas()
    kept_rows = np.zeros(len(sizes), bool)
    for label, share in ((1, 2), (0, 3)):  # each label's rows within its fifths of the bytes; a text beyond them is left out, those after it aren't
        left = sample_bytes * share // 5
        for at in np.flatnonzero(sizes.toxic.to_numpy() == label):
            if sizes.bytes.iat[at] <= left:
                kept_rows[at], left = True, left - int(sizes.bytes.iat[at])
    sizes = sizes[kept_rows]
    if sizes.toxic.nunique() < 2:
        return flat
    wanted = docs.sparkSession.createDataFrame([(int(i), int(t)) for i, t in zip(sizes.doc_id, sizes.toxic)], "doc_id long, toxic int")
    sample = stored(texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text"), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for label, found in zip(batch.column(0).to_pylist(), features(batch.column(1))):
                totals[label, found] += 1
        used = np.flatnonzero(totals.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[1, used]), pa.array(totals[0, used])], ["feature", "toxic", "clean"])

    sums = sample.mapInArrow(count, "feature int, toxic int, clean int").groupBy("feature").agg(F.sum("toxic").cast("int").alias("toxic"), F.sum("clean").cast("int").alias("clean"))
    counted = sums.where("toxic + clean > 1").toArrow()
    in_toxic, in_clean = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for into, column in ((in_toxic, 1), (in_clean, 2)):
        into[counted.column(0).to_numpy()] = counted.column(column).to_numpy()
    ratio = log_count_ratio(in_toxic, in_clean, float((sizes.toxic == 1).sum()), float((sizes.toxic == 0).sum()))
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f[sent.value[f] != 0] for f in features(batch.column(1))]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), binary_rows(np.concatenate(found), np.array([len(f) for f in found]))], ["toxic", "found"])

    rows = sample.mapInArrow(describe, "toxic int, found binary").toArrow()
    data = [np.frombuffer(x.as_buffer(), np.int32) for x in rows.column(1).combine_chunks()]
    return fit(data, rows.column(0).to_numpy(), ratio, n_toxic / (n_toxic + n_clean))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([known.score(f) for f in features(batch.column(1))], pa.float64())], [id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(scored, f"{id_col} {dict(docs.dtypes)[id_col]}, score double")


def scored_rows(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """The documents with all their columns and a score beside them, without a join."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([known.score(f) for f in features(batch.column(at))], pa.float64())], [*batch.schema.names, score_col])

    return docs.mapInArrow(scored, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""MinHash near-dedup by a signature-coordinate inverted join.

A document's set holds its distinct word shingles; documents of equal sets form a class before any
signature is posted. A signature has `coordinates` coordinates of `rows` minima each, so that two
sets of similarity s agree in a coordinate with probability s^rows. Two classes can be linked if they
agree in `matches` coordinates or more, so each class is posted under the prefix of coordinates -
matches + 1 coordinate-value pairs only: one of them must collide. Merging the posting lists counts a
pair's collisions there; the lists of the other coordinates are skipped: a posting carries a sketch of them, on which
a pair that met is probed. Pairs of `matches` agreements or more go on, and their links are confirmed on full sets
(see `near`, also for long lists). At similarity 0.8 and the default parameters the
chance that a true pair agrees in fewer than `matches` coordinates is about 4 in ten million.

Cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a
text with fewer words than a shingle has the whole sequence as its one shingle; rows that share an id
are documents of their own, whose class may have that id as its smallest; a null id is smaller than
none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybreak.llm import near
from daybreak.llm.common import LOWER_AZ, NOT_SPACE, binary_rows, bitset, filter_bits, fresh, in_bitset, mix64, remove, shingle_hashes, ship, sorted_sets, stored, table, text_slices, word_hashes

SETS = "doc_id long, row long, n_shingles long, h1 long, h2 long, sig binary"


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct shingle hashes of these rows in ascending order by row, their number)."""
    for row, end, data, offsets in text_slices(column, 1 << 18):
        words, counts = word_hashes(data, offsets, NOT_SPACE, LOWER_AZ)
        hashes, counts = shingle_hashes(words, counts, size)
        yield row, end, *sorted_sets(hashes, counts)


def set_names(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set, whatever its order."""
    ends = np.cumsum(counts)
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(hashes * f), dtype=np.uint64)]) for f in (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))]
    one, two = (s[ends] - s[ends - counts] for s in sums)
    return one.view(np.int64), two.view(np.int64)


def near_duplicates(
    docs: DataFrame,
    *,
    shingle_words: int = 5,
    percent: int = 80,
    coordinates: int = 40,
    rows: int = 3,
    matches: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, row, group) of every document; component_id is the smallest id reachable by links.

    row is a hash of id and text; group numbers the components, null for an empty set.
    """
    spark = docs.sparkSession
    ship(spark)
    prefix = coordinates - matches + 1
    skipped = min(coordinates - prefix, near.SKETCHED)  # what a sketch has no room for counts as if it agreed
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = texts.select("doc_id", "text", row_key("doc_id", "text").alias("row"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, hashes, counts in shingle_sets(batch.column(1), shingle_words):
                one, two = set_names(hashes, counts)
                some = counts > 0
                sizes = np.where(some, coordinates, 0)
                minima = near.minhash(hashes, counts[some], coordinates * rows) if some.any() else np.empty((0, coordinates * rows), np.uint64)
                signature = binary_rows(near.folded(minima, rows).ravel(), sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), batch.column(2).slice(row, end - row), pa.array(counts), pa.array(one), pa.array(two), signature], ["doc_id", "row", "n_shingles", "h1", "h2", "sig"])

    sets = stored(keyed.mapInArrow(describe, SETS), "sets")
    grouped = sets.where("n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("first"), F.min("sig").alias("sig"))
    classes = stored(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    bits = near.bucket_bits(classes.count() * prefix, 1 << 18)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = near.Postings(bits, sketched=skipped > 0)
        for batch in batches:
            if batch.num_rows:
                whole = np.stack([np.frombuffer(s.as_buffer(), np.uint64, coordinates) for s in batch.column(1)])
                yield from out.add(whole[:, :prefix], batch.column(0).to_numpy(), near.sketches(whole[:, prefix : prefix + skipped], batch.column(2).to_numpy()))
        yield out.flush()

    found = near.found_pairs(classes.select("cls", "sig", "n_shingles").mapInArrow(post, near.Postings.SCHEMA), "document-pairs", bits, 1 << bits, skipped)
    candidates = near.Candidates(found, matches - (coordinates - prefix - skipped))
    remove(found)
    met = stored(candidates.ids().withColumnRenamed("id", "cls").join(classes, "cls").select("cls", F.col("first").alias("id"), "n_shingles", "h1", "h2"), "met")
    bodies = _class_texts(texts, met, shingle_words)
    remove(met)

    def confirm(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(bodies.toDF("a", "ta"), "a").join(bodies.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
        return joined.mapInArrow(near.similar(lambda column: shingle_sets(column, shingle_words), percent), "a long, b long")

    def marks(ids: DataFrame) -> DataFrame:
        of = near.marked(lambda column: shingle_sets(column, shingle_words), 2048, lambda hashes, counts: near.folded(near.minhash(hashes, counts, coordinates * rows), rows))
        return bodies.withColumnRenamed("cls", "id").join(ids, "id").select("id", "text").mapInArrow(of, "id long, size long, mark binary")

    roots = near.linked(candidates, confirm, near.Rest(marks, percent, coordinates, matches))
    candidates.drop()
    remove(bodies)
    named = classes.join(roots.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    linked_classes = stored(named.join(smallest, "root").select("n_shingles", "h1", "h2", "component_id", F.col("root").alias("group")), "components")
    remove(classes, roots)
    out = sets.select("doc_id", "row", "n_shingles", "h1", "h2").join(linked_classes, ["n_shingles", "h1", "h2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "row", "group")


def row_key(id_col: str, text_col: str) -> Column:
    """What tells the rows of a table apart but for those that agree in id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def first_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The documents without near-duplicates: of each group the row of smallest id stays (a null id comes last; of rows that share
    it that of smallest row key, of rows that agree in id and text the first as JSON). Documents of an empty set stay."""
    found = stored(near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("group is not null").select("doc_id", "row", "group"), "groups")
    best = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("best")).select(F.col("group").alias("of"), F.col("best.row").alias("kept"))
    gone = found.join(best, F.col("group") == F.col("of")).where("row <> kept").select("row").distinct()
    key = fresh("row_key", docs)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.withColumn(key, row_key(id_col, text_col)).join(gone.withColumnRenamed("row", key), key, "left_anti")
    repeated = stored(found.groupBy("row").count().where("count > 1").select(F.col("row").alias(key)), "repeated-rows")
    if repeated.isEmpty():
        return kept.select(*columns)
    whole = F.struct(*columns)
    once = kept.join(repeated, key, "left_semi").groupBy(key).agg(F.min_by(whole, F.to_json(whole)).alias("whole")).select("whole.*")
    return kept.join(repeated, key, "left_anti").select(*columns).unionByName(once)


def _class_texts(texts: DataFrame, met: DataFrame, shingle_words: int) -> DataFrame:
    """(cls, text): a text of each class; of rows that share an id only those of the class's own set count.

    A filter of fixed size over the wanted ids lets few other documents into the join.
    """
    sent = texts.sparkSession.sparkContext.broadcast(bitset(met.where("id is not null"), filter_bits(met.count())))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            yield batch.filter(pa.array(in_bitset(sent.value, ids.fill_null(0).to_numpy()) | ids.is_null().to_numpy(zero_copy_only=False)))

    def matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, hashes, counts in shingle_sets(batch.column(1), shingle_words):
                one, two = set_names(hashes, counts)
                part = batch.slice(row, end - row)
                keep = pa.array((one == part.column(2).to_numpy()) & (two == part.column(3).to_numpy()))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["cls", "text"])

    some = texts.mapInArrow(wanted, "doc_id long, text string")
    rows = some.join(met, some.doc_id.eqNullSafe(met.id)).select("cls", "text", "h1", "h2")
    return stored(rows.mapInArrow(matching, "cls long, text string").dropDuplicates(["cls"]), "class-texts")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w
), x AS (SELECT doc_id, unnest(s) AS h FROM s), n AS (SELECT doc_id, len(s) AS n FROM s),
c AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1), y AS (SELECT x.* FROM x SEMI JOIN c USING (h)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM y a JOIN y b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, u.b FROM (SELECT * FROM r) r JOIN u ON u.a = r.b)
"""
OP10_SQL = OP10_SQL.replace("WITH w AS", "WITH RECURSIVE w AS") + """
SELECT n.doc_id, n.n::BIGINT AS n_shingles, g.component_id, n.doc_id = g.component_id AS kept
FROM n JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) g USING (doc_id)
"""

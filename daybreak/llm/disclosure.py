"""Personal data, and the terms that would still reveal it: information-theoretic sanitisation.

Patterns find the protected entities (e-mail addresses, IP addresses, card and telephone numbers). What else must go
is learned from the corpus. A term within WINDOW words of a mention is evidence that it belongs to the entity; over all N documents

    disclosure(term, entity) = log(n_et N / (n_e n_t)) / log(N / n_e),

pointwise mutual information over the entity's own information: n_et documents have the term near the entity, n_e the
entity, n_t the term anywhere. It is 1 where the term occurs with the entity only, and 0 where both are
independent. At `remove` or more a term is removed, at `generalise` or more it is replaced by its class (a name, a number, a word);
either happens at every occurrence in a document that has the term near that entity. Copies of a text are no evidence of their own:
a pair counts only from `min_docs` documents and `min_contexts` different neighbourhoods (the words before and after the term).
The latter are counted as different bins among 64, which partial aggregates hold in one number; it never counts too many.

Documents are read twice, and their texts are never shuffled: once for mentions, the terms around these and their
places, once for n_t of the terms that have evidence (a filter of bounded size lets few others through, an exact join
drops these). Pairs meet by (entity, term); nothing about a frequent entity is gathered in one row.

Cases: a null text is empty; rows may repeat, and each is a document of its own; null ids stay; texts of any length are scanned
in linear time; words of fewer than three letters or digits are no terms, words within a mention neither, words
of over 64 are known by their digest; an entity of every document carries no information, so nothing discloses it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybreak.llm.common import bitset, filter_bits, ship, stored, table

KINDS = ("email", "ip", "card", "phone")
LEVELS = ("generalised", "removed")
#: Words on either side of a mention.
WINDOW = 20
#: Distinct words that a task holds before it sends their counts.
HELD_WORDS = 1 << 17

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match never begins inside a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W_]{3,}")


class Thresholds(NamedTuple):
    generalise: float = 0.9
    remove: float = 0.97
    min_docs: int = 3
    min_contexts: int = 3


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@ and a domain: from each @ to the left as far as the last match lets it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def mentions(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, entity) of all personal data, by kind and start; positions are code points, ends exclusive."""
    out = [(0, a, b, f"email:{text[a:b].lower()}") for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [x.lstrip("0") or "0" for x in m[0].split(".")]
        if all(len(x) < 4 and int(x) < 256 for x in parts):
            out.append((1, m.start(), m.end(), f"ip:{'.'.join(parts)}"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 38 and 13 <= len(digits := _DIGITS.sub("", m[0])) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end(), f"card:{digits}"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(digits := _DIGITS.sub("", m[0])) <= 15:
                out.append((3, m.start(), m.end(), f"phone:{digits}"))
    return out


def term_of(word: str) -> str:
    folded = word.lower()
    return folded if len(folded) <= 64 else "#" + hashlib.sha256(folded.encode()).hexdigest()


def surroundings(text: str, found: list[tuple[int, int, int, str]]) -> tuple[dict[tuple[str, str], int], dict[str, list[int]]]:
    """The bin of the neighbourhood of each (entity, term), and the places of those terms, start << 32 | end."""
    words, taken, at = [], sorted((a, b) for _, a, b, _ in found), 0
    upto = 0  # the end of all mentions that begin before a word
    for m in _WORD.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            upto = max(upto, taken[at][1])
            at += 1
        if upto <= m.start():
            words.append((m.start(), m.end(), term_of(m[0])))
    starts = [w[0] for w in words]
    pairs: dict[tuple[str, str], int] = {}
    for _, _, end, entity in found:
        i = bisect_left(starts, end)
        for k in range(max(0, i - WINDOW), min(len(words), i + WINDOW)):
            if (pair := (entity, words[k][2])) not in pairs:
                near = (words[k - 1][2] if k else "") + "\0" + (words[k + 1][2] if k + 1 < len(words) else "")
                pairs[pair] = xxhash.xxh64_intdigest(near.encode()) & 63
    places: dict[str, list[int]] = {t: [] for _, t in pairs}
    for a, b, t in words:
        if t in places:
            places[t].append(a << 32 | b)
    return pairs, places


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base string, entities array<string>, pairs array<struct<entity:string,term:string,bin:int>>, places array<struct<term:string,at:array<long>>>"


def scan(docs: DataFrame, id_col: str, text_col: str, keep_text: bool) -> DataFrame:
    """Mentions of every document and the terms around them, as a stored table whose rows are numbered."""
    names = [f.split()[0] for f in FOUND.split(", ")]
    types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.string()), pa.list_(pa.struct({"entity": pa.string(), "term": pa.string(), "bin": pa.int32()})), pa.list_(pa.struct({"term": pa.string(), "at": pa.list_(pa.int64())}))]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                found = mentions(text or "")
                counts = Counter(x[0] for x in found)
                pairs, places = surroundings(text, found) if found else ({}, {})
                base = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in found)
                out.append((*(counts[k] for k in range(4)), base, sorted({x[3] for x in found}), [{"entity": e, "term": t, "bin": x} for (e, t), x in pairs.items()], [{"term": t, "at": at} for t, at in places.items()]))
            kept = [batch.column(0), *([batch.column(1)] if keep_text else [])]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([r[k] for r in out], t) for k, t in enumerate(types))], ["id", *(["text"] if keep_text else []), *names])

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, {'text string, ' if keep_text else ''}{FOUND}"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(look, schema)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "mentions")


def document_counts(docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """(term, n_t): in how many documents each of the terms occurs."""
    bits = filter_bits(terms.count())
    sent = docs.sparkSession.sparkContext.broadcast(bitset(terms.select(F.xxhash64("term").alias("id")), bits))
    mask = (1 << bits) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = sent.value, Counter()

        def wanted(term: str) -> bool:
            place = xxhash.xxh64_intdigest(term.encode(), 42) & mask  # as Spark's xxhash64
            return bool(int(known[place >> 6]) >> (place & 63) & 1)

        def send() -> pa.RecordBatch:
            some = [(t, n) for t, n in held.items() if wanted(t)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["term", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    held.update({term_of(w) for w in set(_WORD.findall(text))})
                if len(held) > HELD_WORDS:
                    yield send()
        yield send()

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "term string, n long")
    return rows.groupBy("term").agg(F.sum("n").alias("n_t")).join(terms, "term")


def disclosing(docs: DataFrame, found: DataFrame, text_col: str, limits: Thresholds) -> DataFrame:
    """(entity, term, disclosure, level) of the pairs at or above the lower threshold; level is the place in LEVELS."""
    n = found.count()
    of_entity = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    pairs = found.select(F.inline("pairs"))
    bins = F.bit_or(F.expr("shiftleft(1L, bin)"))
    evidence = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.bit_count(bins).alias("contexts")).where((F.col("n_et") >= limits.min_docs) & (F.col("contexts") >= limits.min_contexts))
    evidence = stored(evidence.join(of_entity.where(F.col("n_e") < n), "entity"), "evidence")
    counts = document_counts(docs, evidence.select("term").distinct(), text_col)
    share = F.log(F.col("n_et") * F.lit(float(n)) / (F.col("n_e") * F.col("n_t"))) / F.log(F.lit(float(n)) / F.col("n_e"))
    scored = evidence.join(counts, "term").select("entity", "term", share.alias("disclosure"))
    return scored.where(F.col("disclosure") >= limits.generalise).withColumn("level", (F.col("disclosure") >= limits.remove).cast("int"))


def disclosures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limits: Thresholds = Thresholds(), keep_text: bool = False) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base (spans of personal data) and spans (with those of disclosing terms).

    Spans are kind:start:end in the order of KINDS and LEVELS, then of their start, joined by commas.
    """
    ship(docs.sparkSession)
    found = scan(docs, id_col, text_col, keep_text)
    pairs = found.select("row", F.inline("pairs"))
    levels = stored(disclosing(docs, found, text_col, limits), "disclosing")
    hits = pairs.join(levels, ["entity", "term"]).groupBy("row", "term").agg(F.max("level").alias("level"))
    hits = stored(hits, "hits")
    places = found.join(hits.select("row").distinct(), "row", "left_semi").select("row", F.inline("places"))
    spans = hits.join(places, ["row", "term"]).select("row", "level", F.explode("at").alias("at"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "at"))), _span_text), ",")
    added = spans.groupBy("row").agg(joined.alias("added"))
    whole = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "added")
    return found.join(added, "row", "left").select("id", *(["text"] if keep_text else []), "n_email", "n_ip", "n_card", "n_phone", "base", whole.alias("spans"))


def _span_text(x: Column) -> Column:
    return F.concat_ws(":", F.element_at(F.array(*map(F.lit, LEVELS)), x["level"] + 1), F.shiftright(x["at"], 32).cast("string"), x["at"].bitwiseAND(F.lit(0xFFFFFFFF)).cast("string"))


def redacted(text: str, spans: str) -> str:
    """The text with every span replaced: personal data by its kind, terms by their class or nothing; overlapping spans count as the first of them."""
    out, at = [], 0
    found = sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x))
    for start, end, kind in found:
        end = -end
        if start < at:
            at = max(at, end)
            continue
        word = text[start:end]
        shape = "number" if word.isdigit() else "name" if word[:1].isupper() else "word"
        out += [text[at:start], {"removed": "", "generalised": f"[{shape}]"}.get(kind, f"[{kind}]")]
        at = end
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limits: Thresholds = Thresholds()) -> DataFrame:
    """(id, text, spans) with what the spans cover replaced; a null text stays null."""
    rows = disclosures(docs, id_col=id_col, text_col=text_col, limits=limits, keep_text=True).select("id", "text", "spans")

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redacted(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2)], ["id", "text", "spans"])

    return rows.mapInArrow(redact, rows.schema)


def op12_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosures(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")

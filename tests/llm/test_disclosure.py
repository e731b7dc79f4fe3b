"""Personal data and disclosing terms against plain patterns and counts."""

from __future__ import annotations

import hashlib
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from daybreak.llm import disclosure

SCHEMA = "doc_id long, text string, `row` string, entity string, base int"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, found):
    digits = [int(x) for x in found if x.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        doubled = [sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(kind, m.start(), m.end(), m[0]) for kind, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(kind, m[0])]


PIECES = st.sampled_from([*"ab1.@-+ ()_%é5", "a@b.c", "1.2.3.4", "255.256.1.1", "4111 1111-1111 1111", "4111111111111112", "+1 (555) 123-4567", "١", "\U0001f600", "x@y", "00"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_mentions_are_the_matches_of_the_patterns(text):
    assert [(disclosure.KINDS[k], a, b) for k, a, b, _ in disclosure.mentions(text)] == [x[:3] for x in base(text)]


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "a@" * 100_000, "1 " * 100_000, "a@" + "b." * 100_000 + "@"])
def test_long_texts_take_linear_time(text):
    disclosure.mentions(text)


def entity(kind, found):
    digits = "".join(x for x in found if x.isdigit())
    return f"{kind}:" + {"email": found.lower(), "ip": ".".join(str(int(x)) for x in found.split(".")) if kind == "ip" else ""}.get(kind, digits)


def brute(rows, limits, window=20):
    """Every document's row by counts over sets, with the bins of neighbourhoods as the operator defines them."""
    import xxhash

    per_doc, has_term = [], {}
    for k, (_, text) in enumerate(rows):
        text = text or ""
        found = base(text)
        covered = {i for _, a, b, _ in found for i in range(a, b)}
        for w in re.findall(r"[^\W_]{3,}", text):
            has_term.setdefault(w.lower(), set()).add(k)
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]{3,}", text) if not covered & set(range(m.start(), m.end()))]
        pairs = {}
        for kind, _, end, s in found:
            after = sum(w[0] < end for w in words)
            for j in range(max(0, after - window), min(len(words), after + window)):
                near = (words[j - 1][2] if j else "") + "\0" + (words[j + 1][2] if j + 1 < len(words) else "")
                pairs.setdefault((entity(kind, s), words[j][2]), xxhash.xxh64(near.encode()).intdigest() % 64)
        per_doc.append((found, words, pairs))
    n, levels = len(rows), {}
    for e, t in {p for _, _, pairs in per_doc for p in pairs}:
        own = [pairs[e, t] for _, _, pairs in per_doc if (e, t) in pairs]
        n_e = sum(any(entity(x[0], x[3]) == e for x in found) for found, _, _ in per_doc)
        if len(own) >= limits.min_docs and len(set(own)) >= limits.min_contexts and n_e < n:
            d = math.log(len(own) * n / (n_e * len(has_term[t]))) / math.log(n / n_e)
            if d >= limits.generalise:
                levels[e, t] = d >= limits.remove
    out = []
    for (i, _), (found, words, pairs) in zip(rows, per_doc):
        hit = {}
        for p in pairs:
            if p in levels:
                hit[p[1]] = max(hit.get(p[1], False), levels[p])
        added = sorted((hit[t], a, b) for a, b, t in words if t in hit)
        text = [f"{k}:{a}:{b}" for k, a, b, _ in found]
        counts = [sum(x[0] == k for x in found) for k in PATTERNS]
        out.append((i, *counts, hashlib.sha256(",".join(text).encode()).hexdigest(), ",".join(text + [f"{disclosure.LEVELS[v]}:{a}:{b}" for v, a, b in added])))
    return sorted(out, key=str)


FILL = "the old house near the river stood empty and everyone in town knew why nobody went there after dark wrote from yesterday left".split()


def corpus():
    rows = [(k, " ".join(FILL[(k * 3 + j) % len(FILL)] for j in range(12 + k % 5))) for k in range(150)]
    for k in range(12):  # a name that goes with an address only, and a nickname that also occurs elsewhere
        a, b = FILL[k], FILL[(k * 5 + 1) % len(FILL)]
        rows.append((200 + k, f"{a} Quillfeather {b} wrote from Quill@Mail.example.com {b} zebulon {a} yesterday; Quillfeather left"))
    rows += [(300, "zebulon alone"), (301, "no zebulon"), (302, None), (303, ""), (303, ""), (None, "call +1 (555) 123-4567 é 10.0.0.1"), (305, "word " * 3000 + "a@b.co " * 50 + "x" * 100)]
    rows += [(400 + k, "copied text of one plumber reachable at plumb@pipe.example.com today") for k in range(30)]  # copies are no evidence
    return rows


@pytest.mark.parametrize("held", [1 << 17, 5])
def test_query_equals_counts_over_sets(spark, tmp_path, monkeypatch, held):
    monkeypatch.setattr(disclosure, "HELD_WORDS", held)
    rows = corpus()
    spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    out = disclosure.op12_disclosure(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), *((f"n_{k}", "bigint") for k in PATTERNS), ("base_sha256", "string"), ("spans", "string")]
    want = brute([(i, t) for i, t in rows], disclosure.Thresholds())
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == want
    added = {r[0]: r[6] for r in want if "removed" in r[6] or "generalised" in r[6]}
    assert set(added) == set(range(200, 212)) and all(x.count("removed") == 2 and x.count("generalised") == 1 for x in added.values())


def test_texts_are_sanitised(spark):
    rows = corpus()
    out = {r.id: r.text for r in disclosure.sanitised(spark.createDataFrame([(*r, "c", "c", 1) for r in rows], SCHEMA)).collect()}
    assert out[200] == "the  old wrote from [email] old [word] the yesterday;  left"
    assert out[302] is None and out[300] == "zebulon alone" and out[400] == "copied text of one plumber reachable at [email] today"


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert disclosure.disclosures(empty).count() == 0 and disclosure.sanitised(empty).count() == 0

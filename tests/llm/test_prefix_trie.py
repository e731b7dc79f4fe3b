"""The prefix trie against a walk over all rebuilt conversations."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from daybreak.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int, `PART` string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    groups = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            groups.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    turns = {c: [x[-1] for x in sorted(g)] for c, g in groups.items()}
    members, ends = {}, {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = abs(c) - abs(c) % 5
        seq = tuple(turns.get(base if c >= 0 else -base, [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path, m in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(m) - 1) * len(path[-1][1].encode()) if path else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items()
    )


def got(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 7, "x") for r in rows], SCHEMA)
    out = prefix_trie.prefix_trie(df)
    assert out.columns == NAMES and {t for n, t in out.dtypes if n != "ends_sha256"} == {"bigint"}
    return sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0], r[1]))


CASES = [
    (7, 0, None, None), (7, None, "user", "first"), (7, 1, "user", ""), (5, 0, "user", "hé"), (5, 0, "assistant", "tie"), (5, 0, "user", "hé"),
    (None, 0, "user", "no id"), (6, 3, "user", "hé" * 5000), (-3, 0, "user", "hé"), (-7, 0, "user", "hé"), (0, 1, "user", "hé"), (0, 2, None, "x"), (1001, 0, "u", "gone"),
]


def test_cases(spark):
    assert got(spark, CASES) == brute(CASES)


def test_an_empty_table_has_no_node(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []


@pytest.mark.parametrize("bits", [10, 2])
def test_hot_first_turn_long_and_copied_conversations(spark, monkeypatch, bits):
    """Windows of 4 rows and blocks of 4 ids give what large ones do; one conversation holds a third of all turns."""
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", bits)
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", bits)
    rng = random.Random(5)
    rows = [(12, k, "user", f"t{k % 3}") for k in range(400)]
    for c in range(150):
        if c != 12:
            same = rng.random() < 0.4
            rows += [(c, k, "user" if k % 2 else "assistant", "hello" if same or k == 0 else rng.choice("abc")) for k in range(rng.randint(1, 12))]
    rng.shuffle(rows)
    want = brute(rows)
    assert got(spark, rows) == want
    assert max(r[1] for r in want) > 350 and max(r[3] for r in want) == 150


def test_the_same_turns_in_another_order_are_other_nodes(spark):
    """Words of two letters whose polynomial hashes modulo 2^64 agree."""
    word = "ab"
    for _ in range(9):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(c, k, "user", x) for c, w in ((0, word), (5, word.translate(str.maketrans("ab", "ba")))) for k, x in enumerate(w)]
    assert got(spark, rows) == brute(rows)

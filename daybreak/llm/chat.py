"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, the
user first and the assistant last. Dynamic programming over this automaton finds for every turn the
cheapest way to make the sequence legal: keep it, merge it into the turn before it, give it another
role (alone or with a merge), or put empty turns before it. Costs are parameters. Of equal costs the
choice with the earlier place in `choices` wins, from the last turn backwards.

The costs of a stretch of turns are a small matrix over the automaton's states, and matrices of
neighbouring stretches combine with (min, +) products. So conversations are cut into blocks of bounded
size wherever they are long: a block computes its matrices, those that belong to conversations
across a border are combined by two ordered passes over them, one from either end, which hold a state each, and every block then traces its own turns. No conversation need fit into
a task. Rendering is by turn: each input turn gives the text that it adds, so the fragments in order
are the rendered conversation.

Cases: roles are compared trimmed and lower-cased; a null or unknown role counts as `user` at the cost
of another role; a null text counts as empty; the markers of turns inside a text lose their bars, so no text opens or closes a turn; turns with the same number follow one another by role
and text; a null turn number comes first and a null conversation id is a conversation; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybreak.llm.common import ship, stored, table

ROLES = ("system", "user", "assistant")
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATE_OF = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
#: Which turns may follow each state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 40


class Costs(NamedTuple):
    merge: int = 1
    relabel: int = 2
    insert: int = 3


class Choice(NamedTuple):
    """A way from one state to another over one input turn."""

    source: int
    target: int
    cost: int
    merged: bool
    inserted: tuple[int, ...]


def choices(role: int, costs: Costs, known: bool = True) -> list[Choice]:
    """All ways to take a turn of this role (a state), cheapest kinds first."""
    found = []
    for relabel in (False, True):
        for target in (SYSTEM, USER, ASSISTANT):
            if (target != role or not known) != relabel:
                continue
            cost = costs.relabel * relabel
            for source in range(4):
                for inserted in ((), *((x,) for x in NEXT[source]), *((x, y) for x in NEXT[source] for y in NEXT[x])):
                    last = inserted[-1] if inserted else source
                    if target in NEXT[last]:
                        found.append(Choice(source, target, cost + costs.insert * len(inserted), False, inserted))
                if source == target:
                    found.append(Choice(source, target, cost + costs.merge, True, ()))
    return found


def ending(state: int, costs: Costs) -> tuple[int, tuple[int, ...]]:
    """The cost of ending after this state, and the empty turns that it takes."""
    inserted = {START: (), ASSISTANT: (), USER: (ASSISTANT,), SYSTEM: (USER, ASSISTANT)}[state]
    return costs.insert * len(inserted), inserted


def step_matrices(costs: Costs) -> dict[tuple[int, bool], np.ndarray]:
    out = {}
    for role in (SYSTEM, USER, ASSISTANT):
        for known in (True, False):
            cost = np.full((4, 4), FAR, np.int64)
            for c in choices(role, costs, known):
                cost[c.source, c.target] = min(cost[c.source, c.target], c.cost)
            out[role, known] = cost
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (min, +) product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def role_of(role: str | None) -> tuple[int, bool]:
    state = STATE_OF.get((role or "").strip().lower())
    return (USER, False) if state is None else (state, True)


def trace(roles: list[tuple[int, bool]], entry: int, to_go: np.ndarray, costs: Costs) -> list[Choice]:
    """The choices of a stretch from its entry state, when leaving in each state costs to_go."""
    steps = {key: choices(*((key[0], costs, key[1]))) for key in set(roles)}
    best = [to_go.tolist()]
    for key in reversed(roles):
        after, before = best[-1], [FAR] * 4
        for c in steps[key]:
            cost = c.cost + after[c.target]
            if cost < before[c.source]:
                before[c.source] = cost
        best.append(before)
    best.reverse()
    out, state = [], entry
    for at, key in enumerate(roles):
        pick = next(c for c in steps[key] if c.source == state and c.cost + best[at + 1][c.target] == best[at][state])
        out.append(pick)
        state = pick.target
    return out


def opened(state: int) -> str:
    return f"<|im_start|>{ROLES[state - 1]}\n"


CLOSED = "<|im_end|>\n"


def harmless(text: str | None) -> str:
    return (text or "").replace("<|im_start|>", "<im_start>").replace("<|im_end|>", "<im_end>")


def fragment(choice: Choice, text: str, closes: tuple[int, ...] | None) -> str:
    """What a turn adds: the end of the turn before it unless it merges, empty turns, itself, and the end of the conversation."""
    if choice.merged:
        out = f"\n{text}"
    else:
        out = (CLOSED if choice.source != START else "") + "".join(opened(x) + CLOSED for x in choice.inserted) + opened(choice.target) + text
    return out if closes is None else out + CLOSED + "".join(opened(x) + CLOSED for x in closes)


TURNS = "conv_id long, position long, turn long, role string, new_role string, action string, inserted int, cost long, rendered string"


def repair(conversations: DataFrame, *, costs: Costs = Costs(), block_rows: int = 20_000) -> DataFrame:
    """One row per input turn, in order of position: its new role, what was done, its cost and the text it adds.

    cost is the turn's own; the empty turns that end a conversation count with its last turn.
    """
    spark = conversations.sparkSession
    ship(spark)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("tie", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "text", "tie"]
    n = rows.count()
    blocks = max(1, -(-n // block_rows))
    ordered = stored(rows.repartitionByRange(blocks, *order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "turns")
    matrices = step_matrices(costs)

    def edges(part: pa.Table) -> pa.Table:
        """The matrix of the first and the last conversation of a block."""
        part = part.sort_by("place")
        ids, roles = part.column("conv_id").to_pylist(), part.column("role").to_pylist()
        out = []
        for at in _runs(ids, first_and_last=True):
            matrix = np.where(np.eye(4, dtype=bool), 0, FAR)
            for i in at:
                matrix = product(matrix, matrices[role_of(roles[i])])
            out.append((part.column("block")[0].as_py(), at[0] == 0, at[-1] == len(ids) - 1, ids[at[0]], len(at), matrix.ravel().tolist()))
        names = ["block", "is_first", "is_last", "conv_id", "n", "matrix"]
        types = [pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    border = ordered.groupBy("block").applyInArrow(edges, "block int, is_first boolean, is_last boolean, conv_id long, n long, matrix array<long>")
    settled = _borders(stored(border, "borders"), costs)

    def trace_block(part: pa.Table, given: pa.Table) -> pa.Table:
        if not part.num_rows:
            return pa.table([pa.array([], t) for t in types], names=[f.split()[0] for f in TURNS.split(", ")])
        entries = {r["block"]: r["entry"] for r in given.to_pylist() if r["enters"]}
        before = {r["block"]: r["before"] for r in given.to_pylist() if r["enters"]}
        exits = {r["block"]: [0 if s == r["leaves"] else FAR for s in range(4)] for r in given.to_pylist() if r["leaves"] is not None}
        part = part.sort_by("place")
        block = part.column("block")[0].as_py()
        ids, turns, roles, texts = (part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))
        out = []
        for at in _runs(ids):
            key = block, at[0] == 0, at[-1] == len(ids) - 1
            entry = entries.get(block, START) if key[1] else START
            skipped = before.get(block, 0) if key[1] else 0
            last = not (key[2] and block in exits)
            to_go = np.array([ending(s, costs)[0] for s in range(4)]) if last else np.array(exits[block])
            known = [role_of(roles[i]) for i in at]
            for k, (i, c) in enumerate(zip(at, trace(known, entry, to_go, costs))):
                final = last and k == len(at) - 1
                closes = ending(c.target, costs)[1] if final else None
                done = "merge" if c.merged else "insert" if c.inserted else "keep"
                if c.target != known[k][0] or not known[k][1]:
                    done = "relabel" if done == "keep" else f"relabel+{done}"
                cost = c.cost + (ending(c.target, costs)[0] if final else 0)
                out.append((ids[i], skipped + k, turns[i], roles[i], ROLES[c.target - 1], done, len(c.inserted) + len(closes or ()), cost, fragment(c, harmless(texts[i]), closes)))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[f.split()[0] for f in TURNS.split(", ")])

    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string()]
    return ordered.groupBy("block").cogroup(settled.groupBy("block")).applyInArrow(trace_block, TURNS)


def _runs(ids: list, first_and_last: bool = False) -> Iterator[range]:
    """Ranges of equal neighbouring ids; or of these only the first and the last."""
    bounds = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
    spans = [range(a, b) for a, b in zip(bounds[:-1], bounds[1:])]
    yield from spans[:1] + spans[1:][-1:] if first_and_last else spans


def _borders(border: DataFrame, costs: Costs) -> DataFrame:
    """(block, enters, entry, before, leaves) of stretches of conversations that cross a border of blocks.

    enters: the stretch goes on from the block before, in the state `entry` and after `before` turns; leaves: the only state in
    which it may leave if it goes on. A conversation's stretches pass in order, first from the last one for what is to come, then from the
    first one for what was.
    """
    chains = border.groupBy(F.col("conv_id").alias("chain")).agg(F.countDistinct("block").alias("blocks")).where("blocks > 1").select("chain")
    rows = border.join(chains, F.col("conv_id").eqNullSafe(F.col("chain"))).select("conv_id", "block", "n", "matrix")

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, to_go = None, None
        for batch in batches:
            out = []
            for name, matrix in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if to_go is None or name != known:
                    known, to_go = name, np.array([ending(s, costs)[0] for s in range(4)])
                out.append(to_go.tolist())
                to_go = np.minimum((np.array(matrix).reshape(4, 4) + to_go[None, :]).min(axis=1), FAR)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*batch.schema.names, "to_go"])

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # a conversation's last stretch so far, which doesn't go on unless another follows
        known, state, turns, begun = None, START, 0, False
        names, types = ["block", "enters", "entry", "before", "leaves"], [pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int32()]
        for batch in batches:
            out = []
            for name, block, n, matrix, to_go in zip(*(c.to_pylist() for c in batch.columns)):
                same = begun and name == known
                if held is not None:
                    out.append((*held[:4], held[4] if same else None))
                if not same:
                    known, state, turns, begun = name, START, 0, True
                # this stretch leaves in one cheapest state, in which the next one enters
                leaves = int(np.argmin(np.array(matrix).reshape(4, 4)[state] + np.array(to_go)))
                held = (block, same, state, turns, leaves)
                state, turns = leaves, turns + n
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*held[:4], None), types)], names)

    dealt = rows.repartition("conv_id")
    back = dealt.sortWithinPartitions("conv_id", F.desc("block")).mapInArrow(backwards, "conv_id long, block int, n long, matrix array<long>, to_go array<long>")
    ahead = back.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return ahead.mapInArrow(forwards, "block int, enters boolean, entry int, before long, leaves int")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))

"""Chat formatting with minimum-cost role repair.

A legal conversation is: an optional system turn, then user and assistant turns in alternation, the
last one by the assistant.  Each turn is kept, relabelled, or merged into the one before, and empty
turns may be inserted; dynamic programming over the automaton of legal turns finds the cheapest repair
(fewest turns among equals), and the repaired turns are rendered as text.

A conversation of any length may span tasks.  Turns are sorted into ranges of (conversation, turn); each task reduces
the piece of a conversation at its two borders to a 4 x 4 min-plus matrix; the driver chains these
(two for each task at most) and fixes the states in which every piece starts and ends, and each task repairs its
pieces between them.

The result has one row per source turn or insertion: conv_id, ord (rows of a conversation in order), out_turn (from 0),
role, action, source_turn, source_role, rendered.  The concatenation of `rendered` in order is the conversation.

Edge cases: null or unknown roles cost least to relabel; null texts are empty; ties in `turn` (null last) are ordered by
role and text hash; repeated rows are turns of their own; a null conv_id is a conversation; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from harborline.llm.common import kept, table

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT}
#: Costs and counts of turns share an integer: cost in the high bits, turns in the low ones.
UNIT = 1 << 32
NEVER = 1 << 61


@dataclass(frozen=True)
class Settings:
    relabel: int = 4
    relabel_unknown: int = 1  # of a turn whose role is missing or unknown
    merge: int = 2
    insert: int = 5
    open: str = "<|{role}|>\n"
    close: str = "<|end|>\n"
    join: str = "\n"


@dataclass(frozen=True)
class Step:
    """A way to take a source turn: insertions, then a turn of `role`, or a merge into the turn before."""

    cost: int
    inserted: tuple[int, ...]
    role: int
    merged: bool


@cache
def steps(s: Settings) -> dict[tuple[int, int], list[tuple[int, Step]]]:
    """(state, role of the source turn; START: unknown) -> [(new state, step)], cheapest first."""
    out = {}
    for state in NEXT:
        for given in range(4):
            found: dict[int, Step] = {}
            for role in (SYSTEM, USER, ASSISTANT):
                label = 0 if given == role else s.relabel if given else s.relabel_unknown
                ways = [Step(label * UNIT + 1, (), role, False)] if role in NEXT[state] else []
                ways += [Step((label + s.insert) * UNIT + 2, (y,), role, False) for y in NEXT[state] if role in NEXT[y] and y != SYSTEM]
                if role == state:
                    ways.append(Step((label + s.merge) * UNIT, (), role, True))
                for w in ways:
                    if role not in found or w.cost < found[role].cost:
                        found[role] = w
            out[state, given] = sorted(found.items(), key=lambda x: (x[1].cost, x[0]))
    return out


def end_cost(s: Settings) -> list[int]:
    """Of ending in each state: an empty assistant turn after the user; nothing at all is legal, too."""
    return [0, 2 * s.insert * UNIT + 2, s.insert * UNIT + 1, 0]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER)


def reduced(roles: list[int], s: Settings) -> np.ndarray:
    """The cheapest cost from each state to each other over the turns."""
    table_ = steps(s)
    m = np.full((4, 4), NEVER, np.int64)
    np.fill_diagonal(m, 0)
    by_role = {}
    for given in range(4):
        one = np.full((4, 4), NEVER, np.int64)
        for state in range(4):
            for new, w in table_[state, given]:
                one[state, new] = w.cost
        by_role[given] = one
    for r in roles:
        m = times(m, by_role[r])
    return m


def repaired(roles: list[int], start: int, end: int | None, s: Settings) -> tuple[list[Step], int]:
    """The cheapest steps from state start to state end (None: the one that is cheapest to end in), and that state."""
    table_ = steps(s)
    cost, back = {start: 0}, []
    for r in roles:
        new: dict[int, tuple[int, int, Step]] = {}
        for state in sorted(cost):
            for to, w in table_[state, r]:
                c = cost[state] + w.cost
                if to not in new or c < new[to][0]:
                    new[to] = (c, state, w)
        back.append(new)
        cost = {k: v[0] for k, v in new.items()}
    if end is None:
        last = end_cost(s)
        end = min(sorted(cost), key=lambda x: cost[x] + last[x])
    out, state = [], end
    for new in reversed(back):
        _, before, w = new[state]
        out.append(w)
        state = before
    return out[::-1], end


def code_of(role: str | None) -> int:
    return ALIASES.get((role or "").strip().lower(), START)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, object, list[dict]]]:
    """(it is the task's first, conversation, rows) of the runs of one conversation in a task."""
    first, key, rows = True, None, []
    for b in batches:
        for r in b.to_pylist():
            if rows and r["conv_id"] != key:
                yield first, key, rows
                first, rows = False, []
            key = r["conv_id"]
            rows.append(r)
    if rows:
        yield first, key, rows


def _borders(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = []  # the task's first conversation and its last one; those between lie whole in it
        for segment in _segments(batches):
            borders[1:] = [segment]
        out = [(int(not first), key, reduced([code_of(r["role"]) for r in rows], s)) for first, key, rows in borders]
        part = TaskContext.get().partitionId()
        yield pa.record_batch(
            [pa.array([part] * len(out), pa.int32()), pa.array([x[0] for x in out], pa.int32()), pa.array([None if x[1] is None else str(x[1]) for x in out], pa.string()), pa.array([x[2].reshape(-1).tolist() for x in out], pa.list_(pa.int64()))],
            names=["part", "second", "conv", "matrix"],
        )

    return run


def chained(borders: list[tuple[int, int, str | None, np.ndarray]], s: Settings) -> dict[tuple[int, int], tuple[int, int, int, bool]]:
    """(part, second) -> (state before, state after, turns before, it ends the conversation) of border pieces."""
    out, i = {}, 0
    borders = sorted(borders, key=lambda b: b[:2])
    while i < len(borders):
        j = i + 1
        while j < len(borders) and borders[j][2] == borders[i][2] and borders[j][0] > borders[j - 1][0]:
            j += 1
        chain = borders[i:j]
        a = [np.full(4, NEVER, np.int64)]
        a[0][START] = 0
        for b in chain:
            a.append(np.minimum((a[-1][:, None] + b[3]).min(axis=0), NEVER))
        state = int(np.argmin(a[-1] + np.array(end_cost(s))))
        for k in range(len(chain) - 1, -1, -1):
            before = int(np.argmin(a[k] + chain[k][3][:, state]))
            out[chain[k][:2]] = (before, state, int(a[k][before] % UNIT), k == len(chain) - 1)
            state = before
        i = j
    return out


def _render(known: dict, conv_type: pa.DataType, turn_type: pa.DataType, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, rows_out = TaskContext.get().partitionId(), 0, []
        names = ["conv_id", "ord", "out_turn", "role", "action", "source_turn", "source_role", "rendered"]

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows_out, strict=True)) or [()] * 8
            types = [conv_type, pa.int64(), pa.int64(), pa.string(), pa.string(), turn_type, pa.string(), pa.string()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        segments = _segments(batches)
        ahead = next(segments, None)
        while ahead is not None:
            (first, key, rows), ahead = ahead, next(segments, None)
            roles = [code_of(r["role"]) for r in rows]
            where = (part, 0) if first else (part, 1) if ahead is None else None
            if where is None:
                state, end, turns, ends = START, None, 0, True
            else:
                state, end, turns, ends = known[where]
            open_ = turns > 0
            taken, end = repaired(roles, state, end, s)
            for r, w in zip(rows, taken, strict=True):
                for y in w.inserted:
                    rows_out.append((key, part << 40 | n, turns, NAMES[y], "insert", None, None, (s.close if open_ else "") + s.open.format(role=NAMES[y])))
                    turns, n, open_ = turns + 1, n + 1, True
                text = r["text"] or ""
                same = code_of(r["role"]) == w.role
                action = ("merge" if w.merged else "keep") if same else ("merge_relabel" if w.merged else "relabel")
                head = s.join if w.merged else (s.close if open_ else "") + s.open.format(role=NAMES[w.role])
                turns += not w.merged
                rows_out.append((key, part << 40 | n, turns - 1, NAMES[w.role], action, r["turn"], r["role"], head + text))
                n, open_ = n + 1, True
            if ends:
                for y in {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[end]:
                    rows_out.append((key, part << 40 | n, turns, NAMES[y], "insert", None, None, s.close + s.open.format(role=NAMES[y])))
                    turns, n = turns + 1, n + 1
                *rest, text = rows_out[-1]
                rows_out[-1] = (*rest, text + s.close)
            if len(rows_out) >= 2000:
                yield batch()
                rows_out.clear()
        if rows_out:
            yield batch()

    return run


def repair(turns: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per source turn or insertion for every row of turns (conv_id, turn, role, text)."""
    rows = turns.select("conv_id", "turn", "role", "text")
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role"), F.xxhash64("text"), F.col("_row")]
    placed = kept(rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_row"))
    found = placed.select("conv_id", "role").mapInArrow(_borders(s), "part int, second int, conv string, matrix array<long>").collect()  # two rows a task at most
    known = chained([(r.part, r.second, r.conv, np.array(r.matrix, np.int64).reshape(4, 4)) for r in found], s)
    conv, turn = (turns.schema[c].dataType for c in ("conv_id", "turn"))
    return placed.mapInArrow(
        _render(known, to_arrow_type(conv), to_arrow_type(turn), s),
        f"conv_id {conv.simpleString()}, ord long, out_turn long, role string, action string, source_turn {turn.simpleString()}, source_role string, rendered string",
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))

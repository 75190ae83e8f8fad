"""Chat formatting by minimum-cost role repair.

A conversation's roles run through an automaton of legal turns: system may come first, then user
and assistant take turns, user first and assistant last. Each turn is kept, given another role, merged
into the turn before, or preceded by an empty inserted turn; a dynamic programme over the
automaton's states finds the cheapest repair, and the repaired conversation is rendered. Every input
turn gives one row with the part of the rendering that it adds; a conversation's rendering is its rows'
``rendered`` in the order of conv_id and position.

Turns are range-partitioned and sorted by (conv_id, turn), so a conversation of any length lies in
consecutive partitions. The programme's steps are (min, +) matrices: each partition sends the product
for its first and last conversation (two 4 x 4 matrices a partition), the driver finds the states at
partition borders, and partitions then solve their own stretch between fixed states.

Cases: null turns come first in their conversation; null conv_ids are one conversation. A null or unknown
role must get another one. Null texts count as empty. Turns with equal numbers are ordered by role and text; equal
rows come in a row. An empty table gives an empty result; extra columns aren't carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import materialize, shuffle_partitions

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


@dataclass(frozen=True)
class Costs:
    relabel: int = 3
    merge: int = 1
    insert: int = 2


INFINITE = 10**15
Step = tuple[int, str, int]  # cost, action, inserted role (0: none)


def steps(costs: Costs) -> list[list[list[Step | None]]]:
    """[observed role (0: unknown)][state before][state after]: the cheapest step, or None."""
    table: list[list[list[Step | None]]] = []
    for observed in range(4):
        rows = []
        for before in range(4):
            row: list[Step | None] = [None] * 4
            for after in (SYSTEM, USER, ASSISTANT):
                label = 0 if after == observed else costs.relabel
                verb = "keep" if after == observed else "relabel"
                options: list[Step] = []
                if after in _NEXT[before]:
                    options.append((label, verb, 0))
                if after == before:
                    options.append((label + costs.merge, "merge" if verb == "keep" else "relabel_merge", 0))
                options += [(label + costs.insert, verb, x) for x in _NEXT[before] if after in _NEXT[x]]
                row[after] = min(options, key=lambda o: o[0], default=None)
            rows.append(row)
        table.append(rows)
    return table


def closing(costs: Costs) -> list[int]:
    """What it costs to end in each state: an empty assistant turn where the last isn't one."""
    return [INFINITE, INFINITE, costs.insert, 0]


def _cost_table(costs: Costs) -> np.ndarray:
    return np.array([[[INFINITE if s is None else s[0] for s in row] for row in rows] for rows in steps(costs)], dtype=np.int64)


def product(observed: list[int], table: np.ndarray) -> np.ndarray:
    """The (min, +) product of the turns' step matrices."""
    out = np.where(np.eye(4, dtype=bool), 0, INFINITE).astype(np.int64)
    for o in observed:
        out = np.minimum((out[:, :, None] + table[o][None]).min(axis=1), INFINITE)
    return out


def repaired(observed: list[int], costs: Costs, entry: int = START, leave: int | None = None) -> list[tuple[int, Step]]:
    """For each turn its state and step, the cheapest way from ``entry`` to ``leave`` (None: the end of the conversation)."""
    table = steps(costs)
    cost, back = [0 if s == entry else INFINITE for s in range(4)], []
    for o in observed:
        new, came = [INFINITE] * 4, [0] * 4
        for before in range(4):
            if cost[before] < INFINITE:
                for after, step in enumerate(table[o][before]):
                    if step is not None and cost[before] + step[0] < new[after]:
                        new[after], came[after] = cost[before] + step[0], before
        cost = new
        back.append(came)
    end = closing(costs)
    state = min(range(4), key=lambda s: cost[s] + end[s]) if leave is None else leave
    out = []
    for o, came in zip(reversed(observed), reversed(back), strict=True):
        before = came[state]
        out.append((state, table[o][before][state]))
        state = before
    return out[::-1]


def _observed(role: str | None) -> int:
    return ROLES.index(role) + 1 if role in ROLES else 0


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, list[dict]]]:
    """(partition, conv_id, rows) of consecutive rows; rows are sorted."""
    at, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["part"], row["conv_id"])
            if rows and key != at:
                yield *at, rows
                rows = []
            at = key
            rows.append(row)
    if rows:
        yield *at, rows


def borders(chunks: list[tuple[int, int | None, np.ndarray]], costs: Costs) -> dict[tuple[int, int | None], tuple[int, int | None]]:
    """Entry and leaving states of each partition's stretch of the conversations that cross borders."""
    found: dict[int | None, list[tuple[int, np.ndarray]]] = {}
    for part, conv, matrix in sorted(chunks, key=lambda c: c[0]):
        found.setdefault(conv, []).append((part, matrix))
    out = {}
    for conv, parts in found.items():
        if len(parts) < 2:
            continue
        reach = [np.where(np.arange(4) == START, 0, INFINITE)]
        for _, matrix in parts:
            reach.append(np.minimum((reach[-1][:, None] + matrix).min(axis=0), INFINITE))
        state: int | None = int(np.argmin(reach[-1] + np.array(closing(costs))))
        for k in range(len(parts) - 1, -1, -1):
            before = int(np.argmin(reach[k] + parts[k][1][:, state]))
            out[parts[k][0], conv] = before, None if k == len(parts) - 1 else state
            state = before
    return out


def _rendered(role: int, text: str) -> str:
    return f"<|{ROLES[role - 1]}|>\n{text}"


SCHEMA = "conv_id long, position long, turn long, role string, new_role string, action string, inserted string, appended string, cost long, rendered string"


def repair(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """A row for each turn: its new role, what was done, what that cost, and its part of the rendering."""
    n = shuffle_partitions(conversations.sparkSession)
    order = ["conv_id", "turn", "role", "text"]
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    # in the order of the sort, by the beginnings of texts, as the bounds of ranges come to the driver
    ranged = turns.repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, 64)).withColumn("part", F.spark_partition_id())
    table = materialize(ranged, "turns")
    parts = (table.agg(F.max("part")).first()[0] or 0) + 1
    ordered = lambda *c: table.select("part", *c).repartitionById(parts, "part").sortWithinPartitions("part", *order)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for part, conv, rows in _stretches(batches):
            if first is not None and first[0] != part:
                yield from sent(first, last)
                first = last = None
            last = part, conv, [_observed(r["role"]) for r in rows]
            first = first or last
        if first is not None:
            yield from sent(first, last)

    def sent(first, last) -> Iterator[pa.RecordBatch]:
        cost = _cost_table(costs)
        for part, conv, observed in [first] if first is last else [first, last]:
            yield pa.RecordBatch.from_pylist([{"part": part, "conv_id": conv, "matrix": product(observed, cost).ravel().tolist()}], pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("matrix", pa.list_(pa.int64()))]))

    chunks = ordered(*order).mapInArrow(ends, "part int, conv_id long, matrix array<long>").collect()  # two rows a partition
    fixed = borders([(r["part"], r["conv_id"], np.array(r["matrix"]).reshape(4, 4)) for r in chunks], costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in SCHEMA.split(", ")])
        out, k, part_now = [], 0, None
        for part, conv, rows in _stretches(batches):
            if part != part_now:
                k, part_now = 0, part
            entry, leave = fixed.get((part, conv), (START, None))
            done = repaired([_observed(r["role"]) for r in rows], costs, entry, leave)
            for j, (row, (state, (cost, action, inserted))) in enumerate(zip(rows, done, strict=True)):
                merged = action.endswith("merge")
                text = row["text"] or ""
                opened = j == 0 and entry == START
                end = "" if opened else "\n\n" if merged else "<|end|>\n"
                extra = _rendered(inserted, "") + "<|end|>\n" if inserted else ""
                body = end + (text if merged else extra + _rendered(state, text))
                closes = j == len(rows) - 1 and leave is None
                appended = closes and state != ASSISTANT
                if closes:
                    body += "<|end|>\n" + (_rendered(ASSISTANT, "") + "<|end|>\n" if appended else "")
                out.append({
                    "conv_id": conv, "position": part << 40 | k, "turn": row["turn"], "role": row["role"], "new_role": ROLES[state - 1], "action": action,
                    "inserted": ROLES[inserted - 1] if inserted else None, "appended": ROLES[ASSISTANT - 1] if appended else None,
                    "cost": cost + (costs.insert if appended else 0), "rendered": body,
                })
                k += 1
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return ordered(*order).mapInArrow(run, SCHEMA)

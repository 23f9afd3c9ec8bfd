"""Chat formatting with role repair of least cost.

*Legal turns.*  An optional system turn, then user and assistant in alternation, closed by the assistant.

*Repair.*  Each message becomes a turn of some role, or is merged into the turn before it; empty turns may be
inserted.  Merging, relabelling and inserting have costs; dynamic programming over the automaton of legal
turns finds the cheapest repair of the conversation.  Ties go to the smaller change: merging before inserting
before relabelling, and earlier roles of the list below before later ones.

*Scale.*  Messages are sorted over the cluster by conversation and turn and cut into pieces of at most
``PIECE`` messages.  A piece that may be part of a longer conversation is summed up as a table of least costs
from each state before it to each state after it.  These small tables are chained per conversation, which
fixes the states at the pieces' ends; then every piece is repaired on its own.  A conversation of any length
is thus repaired exactly by many tasks.

*Rendering.*  Each message, and each inserted turn, gives one row with its fragment; the fragments of a
conversation joined in order of ``position`` are the rendered conversation.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from fellscape.llm.common import broadcast_if_small
from fellscape.session import cut, task_count

PIECE = 20_000
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)  # the last turn's role
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Names that stand for a role.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "ai": "assistant", "model": "assistant"}
FAR = 1 << 60


@dataclass(frozen=True)
class Costs:
    merge: int = 10
    insert: int = 25
    relabel: int = 31


@dataclass(frozen=True)
class Template:
    head: str = "<|{role}|>\n"
    joint: str = "\n"
    tail: str = "<|end|>\n"


def role_of(name: str | None) -> int:
    """State of a role name in any case; 0 for NULL and unknown names."""
    low = (name or "").strip().lower()
    low = ALIASES.get(low, low)
    return ROLES.index(low) + 1 if low in ROLES else 0


def steps(role: int, costs: Costs) -> list[list[tuple[int, int, int, bool]]]:
    """From each state the ways to take a message: next state, cost, inserted role (0: none), merged."""
    table = []
    for state in range(4):
        ways = []
        for target in (SYSTEM, USER, ASSISTANT):
            change = 0 if target == role else costs.relabel
            if target == state:
                ways.append((target, change + costs.merge, 0, True))
            if target in NEXT[state]:
                ways.append((target, change, 0, False))
            for between in NEXT[state]:
                if target in NEXT[between]:
                    ways.append((target, change + costs.insert, between, False))
        table.append(ways)
    return table


def closing(state: int, costs: Costs) -> tuple[int, list[int]]:
    """Cost and inserted roles that end a conversation after ``state``."""
    missing = {START: [], ASSISTANT: [], USER: [ASSISTANT], SYSTEM: [USER, ASSISTANT]}[state]
    return costs.insert * len(missing), missing


def forward(roles: Sequence[int], entry: int, costs: Costs, tables: dict) -> list[list[tuple | None]]:
    """Least cost, rows and turns to each state after each message, with the step that led there."""
    best: list[tuple | None] = [None] * 4
    best[entry] = (0, 0, 0)
    trail = []
    for role in roles:
        following: list[tuple | None] = [None] * 4
        for state, b in enumerate(best):
            if b is None:
                continue
            for way in tables[role][state]:
                cost = b[0] + way[1]
                old = following[way[0]]
                if old is None or cost < old[0]:
                    following[way[0]] = (cost, b[1] + 1 + (way[2] > 0), b[2] + (way[2] > 0) + (not way[3]), state, way)
        trail.append(following)
        best = [f and f[:3] for f in following]
    return trail


def summary(roles: Sequence[int], costs: Costs, tables: dict) -> list[int]:
    """Costs, rows and turns from each state to each state: 4 x 4 x 3 numbers."""
    out = []
    for entry in range(4):
        last = forward(roles, entry, costs, tables)[-1] if roles else [(0, 0, 0) if s == entry else None for s in range(4)]
        for x in last:
            out += x[:3] if x else (FAR, 0, 0)
    return out


def repaired(roles: Sequence[int], entry: int, leave: int | None, costs: Costs, tables: dict) -> list[tuple[int, int, bool]]:
    """Per message: inserted role before it (0: none), its role, merged.  ``leave`` is the state at the end, or the cheapest end."""
    trail = forward(roles, entry, costs, tables)
    if leave is None:
        leave = min((x[0] + closing(s, costs)[0], s) for s, x in enumerate(trail[-1]) if x)[1]
    out = []
    for following in reversed(trail):
        state, way = following[leave][3:]
        out.append((way[2], way[0], way[3]))
        leave = state
    return out[::-1]


def pieces(rows: DataFrame, costs: Costs) -> DataFrame:
    """The messages in order, with ``piece``, ``at`` and, at the end of a piece that may not be a whole conversation, its ``summary``."""
    schema = T.StructType([*rows.schema.fields, T.StructField("piece", T.LongType()), T.StructField("at", T.LongType()),
                           T.StructField("open", T.BooleanType()), T.StructField("summary", T.ArrayType(T.LongType()))])
    names = rows.columns
    order = ["conv_id", "turn", "role", "text"]
    ranged = rows.repartitionByRange(task_count(rows.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {r: steps(r, costs) for r in range(4)}
        piece, held, arrow = TaskContext.get().partitionId() << 32, [], None

        def out(rows: list[dict], number: int, is_open: bool) -> pa.RecordBatch:
            found = summary([role_of(r["role"]) for r in rows], costs, tables) if is_open else None
            columns = [pa.array([r[n] for r in rows], arrow.field(n).type) for n in names]
            n = len(rows)
            columns += [pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([is_open] * n),
                        pa.array([None] * (n - 1) + [found], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=[*names, "piece", "at", "open", "summary"])

        first = True  # the conversation may have begun in the partition before
        for batch in batches:
            arrow = batch.schema
            for row in batch.to_pylist():
                ends = held and held[-1]["conv_id"] != row["conv_id"]
                if ends or len(held) >= PIECE:
                    yield out(held, piece, first or not ends)
                    piece, held, first = piece + 1, [], not ends
                held.append(row)
        if held:
            yield out(held, piece, True)

    return ranged.mapInArrow(run, schema)


def ends(marked: DataFrame, costs: Costs) -> DataFrame:
    """``piece, entry, leave, last, position0, turn0``: the states at both ends of every open piece."""
    chains = (marked.where("summary is not null").groupBy("conv_id")
              .agg(F.sort_array(F.collect_list(F.struct("piece", "summary"))).alias("chain")))
    schema = "piece long, entry int, leave int, last boolean, position0 long, turn0 long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chain in batch.column("chain").to_pylist():
                best: list = [(0, None)] + [None] * 3
                trail = []
                for link in chain:
                    following: list = [None] * 4
                    for state, b in enumerate(best):
                        for leave in range(4):
                            cost = link["summary"][(state * 4 + leave) * 3]
                            if b and cost < FAR and (following[leave] is None or b[0] + cost < following[leave][0]):
                                following[leave] = (b[0] + cost, state)
                    trail.append(following)
                    best = following
                leave = min((x[0] + closing(s, costs)[0], s) for s, x in enumerate(best) if x)[1]
                states = [leave]
                for following in reversed(trail):
                    states.append(following[states[-1]][1])
                states = states[::-1]
                position = turn = 0
                for n, (link, entry, leave) in enumerate(zip(chain, states, states[1:])):
                    out.append((link["piece"], entry, leave, n == len(chain) - 1, position, turn))
                    at = (entry * 4 + leave) * 3
                    position, turn = position + link["summary"][at + 1], turn + link["summary"][at + 2]
            fields = list(zip(*out)) or [()] * 6
            types = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(fields, types)], names=[f.split()[0] for f in schema.split(", ")])

    return chains.mapInArrow(run, schema)


def formatted(messages: DataFrame, costs: Costs = Costs(), template: Template = Template()) -> DataFrame:
    """``conv_id, position, out_turn, new_role, action, turn, role, fragment``: the repaired conversations.

    One row per message and per inserted turn (NULL ``turn`` and ``role``).  ``action`` is ``keep``, ``merge``, ``relabel``,
    ``relabel+merge`` or ``insert``.  Messages are ordered by turn, then role and text; NULL turns come first.
    NULL and unknown roles are relabelled, a NULL text is empty.  Rows without ``conv_id`` are one conversation.
    Repeated rows are messages like others.  An empty table gives an empty result.
    """
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    marked = cut(pieces(rows, costs))
    bounds = cut(ends(marked, costs))
    met = (marked.drop("summary", "open").join(broadcast_if_small(bounds), "piece", "left").repartition("piece").sortWithinPartitions("piece", "at"))
    schema = "conv_id long, position long, out_turn long, new_role string, action string, turn long, role string, fragment string"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def piece_rows(held: list[dict], tables: dict) -> list[tuple]:
        first = held[0]
        roles = [role_of(r["role"]) for r in held]
        alone = first["entry"] is None
        found = repaired(roles, START if alone else first["entry"], None if alone else first["leave"], costs, tables)
        position, turn = (0, 0) if alone else (first["position0"], first["turn0"])
        out: list[tuple] = []

        def add(role: int, action: str, row: dict | None, text: str) -> None:
            nonlocal position, turn
            if action.endswith("merge"):
                fragment = template.joint + text
            else:
                fragment = (template.tail if turn else "") + template.head.format(role=ROLES[role - 1]) + text
                turn += 1
            out.append((first["conv_id"], position, turn - 1, ROLES[role - 1], action, row and row["turn"], row and row["role"], fragment))
            position += 1

        for row, was, (between, role, merged) in zip(held, roles, found):
            if between:
                add(between, "insert", None, "")
            action = "+".join([*["relabel"] * (role != was), *["merge"] * merged]) or "keep"
            add(role, action, row, row["text"] or "")
        if alone or first["last"]:
            for role in closing(found[-1][1], costs)[1]:
                add(role, "insert", None, "")
            out[-1] = (*out[-1][:-1], out[-1][-1] + template.tail)
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, out = {r: steps(r, costs) for r in range(4)}, [], []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(types)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in schema.split(", ")])

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[-1]["piece"] != row["piece"]:
                    out += piece_rows(held, tables)
                    held = []
                held.append(row)
                if len(out) >= PIECE:
                    yield flush()
        if held:
            out += piece_rows(held, tables)
        yield flush()

    return met.mapInArrow(run, schema)

"""Conversations repaired to legal turns at the lowest cost, and rendered.

Legal are turns that an automaton accepts: a system turn at most at the start, then user and assistant in turn, the user first. A turn is
kept, merged into the turn before, relabelled, or preceded by an empty turn; dynamic programming over the automaton's states finds
the cheapest choice for the whole conversation.

The cost of a stretch of turns from each state to each state is a small matrix, and matrices of neighbouring stretches combine. So turns are
sorted and cut into even parts whatever conversation they belong to: each part gives a matrix for each of its conversations, these are
combined along the parts, and each part then finds its own choices between the states at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoiceloom.llm.rows import column, written

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ENDS = (START, SYSTEM, USER, ASSISTANT)

MERGE, RELABEL, INSERT = 1, 2, 3
FAR = 1 << 61
#: Costs come first, then a number drawn from the turn's content: the cheapest choice is one and the same however turns are cut into parts.
UNIT = 1 << 32

Choice = tuple[int, str, str]
"""(cost, what is done, role of the empty turn before it or "")"""


def choices(role: str | None) -> list[list[Choice | None]]:
    """The cheapest way of a turn of this role from each state to each state."""
    own = ROLES.index(role) + 1 if role in ROLES else None
    table: list[list[Choice | None]] = [[None] * 4 for _ in range(4)]

    def offer(s: int, t: int, choice: Choice) -> None:
        if table[s][t] is None or choice[0] < table[s][t][0]:
            table[s][t] = choice

    for s in range(4):
        for t in (SYSTEM, USER, ASSISTANT):
            change = 0 if t == own else RELABEL
            done = "keep" if t == own else "relabel"
            if t in FOLLOWS[s]:
                offer(s, t, (change, done, ""))
            for between in FOLLOWS[s]:
                if t in FOLLOWS[between]:
                    offer(s, t, (change + INSERT, done, ROLES[between - 1]))
        if s != START:
            offer(s, s, (MERGE + (0 if s == own else RELABEL), "merge", ""))
    return table


TABLES = {role: choices(role) for role in (*ROLES, None)}


def steps(role: str | None, draw: int) -> list[list[int]]:
    """Costs of a turn from state to state, with its draws."""
    table = TABLES[role if role in ROLES else None]
    return [
        [FAR if c is None else c[0] * UNIT + ((draw >> (3 * (s * 4 + t))) & 0xFF) for t, c in enumerate(row)]
        for s, row in enumerate(table)
    ]


def through(left: list[list[int]], right: list[list[int]]) -> list[list[int]]:
    return [[min(min(a + right[k][t] for k, a in enumerate(row)), FAR) for t in range(4)] for row in left]


def backwards(matrices: list[list[list[int]]], before: list[int], end: int) -> list[int]:
    """The states after every turn that lead to ``end`` at the lowest cost, preceded by the state they start from."""
    costs = [before]
    for m in matrices:
        last = costs[-1]
        costs.append([min(min(last[s] + m[s][t] for s in range(4)), FAR) for t in range(4)])
    states = [end]
    for m, cost in zip(reversed(matrices), reversed(costs[:-1]), strict=True):
        t = states[-1]
        states.append(min(range(4), key=lambda s: (cost[s] + m[s][t], s)))
    return states[::-1]


NOTHING = [[0 if s == t else FAR for t in range(4)] for s in range(4)]
FRESH = [0, FAR, FAR, FAR]


def repaired(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per turn: conv_id, turn, place, action, new_role, inserted, cost and segment.

    ``place`` orders the turns of a conversation (by turn, then role and text), ``action`` is keep, merge or relabel, ``inserted`` the role of an empty turn put before it (else
    empty), ``segment`` what the turn adds to the rendered conversation: the segments in order, one after another, are the whole rendering.

    Roles are compared in lower case without blanks; null and unknown ones have to be relabelled or merged. Null texts are empty. Null turns
    come first. Rows with a null conversation id are one conversation. Repeated rows are turns like any other, and an empty table gives an empty one.
    """
    turns = df.select(
        column(conversation).cast("long").alias("conv"), column(turn).cast("long").alias("turn"),
        F.lower(F.trim(column(role).cast("string"))).alias("role"), F.coalesce(column(text), F.lit("")).alias("text"),
    )
    order = ["conv", "turn", "role", "text_hash"]
    hashed = turns.withColumn("text_hash", F.xxhash64("text"))
    part, seq = F.spark_partition_id(), F.monotonically_increasing_id()
    cut = hashed.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(cut.withColumn("part", part).withColumn("place", seq), "turns")
    light = placed.select("part", "place", "conv", "turn", "role", "text_hash")
    by_part = light.repartition("part").sortWithinPartitions("part", "place")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
        """Turns of a part and conversation that follow each other."""
        key, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row[0], row[2]) != key:
                    if rows:
                        yield key, rows
                    key, rows = (row[0], row[2]), []
                rows.append(row)
        if rows:
            yield key, rows

    def turn_steps(row: tuple) -> list[list[int]]:
        return steps(row[4], xxhash.xxh64_intdigest(f"{row[2]} {row[3]} {row[5]}"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (number, conv), rows in stretches(batches):
            total = NOTHING
            for row in rows:
                total = through(total, turn_steps(row))
            out.append({"part": number, "conv": conv, "costs": [x for r in total for x in r]})
            if len(out) == 5000:
                yield pa.RecordBatch.from_pylist(out, STRETCH)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, STRETCH)

    def joined(group: pa.Table) -> pa.Table:
        """The stretches of one conversation along the parts: costs before each and the state after each."""
        group = group.sort_by("part")
        matrices = [[c[4 * s : 4 * s + 4] for s in range(4)] for c in group.column("costs").to_pylist()]
        before = [FRESH]
        for m in matrices:
            before.append([min(min(before[-1][s] + m[s][t] for s in range(4)), FAR) for t in range(4)])
        end = min(ENDS, key=lambda t: (before[-1][t], t))
        states = backwards(matrices, FRESH, end)
        return pa.table({
            "part": group.column("part"), "conv": group.column("conv"), "state": pa.array(states[:-1], pa.int32()),
            "end": pa.array(states[1:], pa.int32()), "last": pa.array([i == len(matrices) - 1 for i in range(len(matrices))]),
        })

    spans = written(by_part.mapInArrow(told, "part int, conv long, costs array<long>"), "stretches")
    ends = spans.groupBy("conv").applyInArrow(joined, "part int, conv long, state int, end int, last boolean")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, rows in stretches(batches):
            first, end = rows[0][6], rows[0][7]
            path = backwards([turn_steps(r) for r in rows], [0 if s == first else FAR for s in range(4)], end)
            for i, (row, s, t) in enumerate(zip(rows, path, path[1:], strict=False)):
                cost, action, inserted = TABLES[row[4] if row[4] in ROLES else None][s][t]
                out.append({"part": row[0], "place": row[1], "action": action, "new_role": ROLES[t - 1], "inserted": inserted, "cost": cost,
                            "first": s == START, "final": row[8] and i == len(rows) - 1})
                if len(out) == 5000:
                    yield pa.RecordBatch.from_pylist(out, CHOSEN)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, CHOSEN)

    known = light.join(
        ends.select(F.col("part").alias("p"), F.col("conv").alias("c"), "state", "end", "last"),
        (F.col("part") == F.col("p")) & F.col("conv").eqNullSafe(F.col("c")),
    ).select("part", "place", "conv", "turn", "role", "text_hash", "state", "end", "last")
    decided = known.repartition("part").sortWithinPartitions("part", "place").mapInArrow(
        chosen, "part int, place long, action string, new_role string, inserted string, cost int, first boolean, final boolean"
    )
    met = placed.drop("text_hash").join(decided, ["part", "place"])
    end = F.lit("<|end|>\n")
    close = F.when(F.col("action").isin("keep", "relabel") & ~F.col("first"), end).otherwise("")
    empty = F.when(F.col("inserted") != "", F.concat(F.lit("<|"), "inserted", F.lit("|>\n"), end)).otherwise("")
    head = F.when(F.col("action") != "merge", F.concat(F.lit("<|"), "new_role", F.lit("|>\n"))).otherwise("")
    segment = F.concat(close, empty, head, "text", F.lit("\n"), F.when(F.col("final"), end).otherwise(""))
    return met.select(
        F.col("conv").alias(conversation), F.col("turn").alias("turn"), "place", "action", "new_role", "inserted", F.col("cost").cast("long").alias("cost"),
        segment.alias("segment"),
    )


STRETCH = pa.schema([("part", pa.int32()), ("conv", pa.int64()), ("costs", pa.list_(pa.int64()))])
CHOSEN = pa.schema(
    [("part", pa.int32()), ("place", pa.int64()), ("action", pa.string()), ("new_role", pa.string()), ("inserted", pa.string()), ("cost", pa.int32()), ("first", pa.bool_()), ("final", pa.bool_())]
)

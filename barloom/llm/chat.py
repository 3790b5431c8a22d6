"""Chat formatting with minimum-cost role repair.

A conversation is legal if an optional system turn is followed by user and assistant turns in alternation, ending with the
assistant. Dynamic programming over this automaton chooses, at the least total cost, which turns are merged into the one
before, which are relabelled, and where empty turns are inserted; the result is rendered with start and end marks.

A conversation may be of any length: its rows are numbered by sorted ranges (places within a range, plus the counts of the
ranges before) and cut into blocks by that number, so no block has more than ``BLOCK`` rows, whatever values repeat or
are null. Each block is first summarised as a matrix (least cost from each state before it to each state after it), the
matrices of a conversation are chained, and every block is then repaired between its now known end states. Each text
moves twice, to its range and to its block, and is written once between; all other steps move narrow rows.

The result has a row per turn with its piece of the rendering; the pieces of a conversation in order of ``block`` and
``seq`` are the rendered sequence, merged texts included, so no long conversation is ever held in one value.

Turns are ordered by turn (null first), role and text. Null texts count as empty; null or unknown roles must be
relabelled. Repeated rows are turns of their own and merge. A null conv_id is one conversation. Marks inside texts are
broken up, so that texts cannot open or close a turn. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm.common import arrow_pass
from barloom.session import cut

#: Turns per block.
BLOCK = 1024
# States, other names of roles, and the costs of a repair.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
NAMES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "model": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT}
MERGE, RELABEL, INSERT = 1, 3, 2
FAR = 1 << 40
#: Empty turns needed to go from a state to a new turn of a role; missing where there is no way.
WAYS = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
#: Empty turns that end a conversation legally.
ENDS = {START: (USER, ASSISTANT), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def role_of(name: str | None) -> int:
    """State of a role, -1 for an unknown one."""
    return NAMES.get((name or "").strip().lower(), -1)


def _moves(role: int) -> list[tuple[int, int, int, bool]]:
    """(cost, state before, state after, merged) of every way to take a turn of this role."""
    found = []
    for after in (SYSTEM, USER, ASSISTANT):
        change = 0 if role == after else RELABEL
        found.append((MERGE + change, after, after, True))
        found += [(INSERT * len(empty) + change, before, after, False) for (before, to), empty in WAYS.items() if to == after]
    return sorted(found)


MOVES = {role: _moves(role) for role in (-1, SYSTEM, USER, ASSISTANT)}


def step(costs: list[int], role: int) -> list[int]:
    """Least costs of the states after one more turn."""
    new = [FAR] * 4
    for cost, before, after, _ in MOVES[role]:
        if costs[before] + cost < new[after]:
            new[after] = costs[before] + cost
    return new


def repair(roles: list[int], begin: int, end: int) -> list[tuple[int, int, bool]]:
    """(state before, state after, merged) of each turn on the cheapest way from ``begin`` to ``end``."""
    costs = [[0 if s == begin else FAR for s in range(4)]]
    for role in roles:
        costs.append(step(costs[-1], role))
    way, state = [], end
    for k in range(len(roles) - 1, -1, -1):
        move = next(m for m in MOVES[roles[k]] if m[2] == state and costs[k][m[1]] + m[0] == costs[k + 1][state])
        way.append((move[1], move[2], move[3]))
        state = move[1]
    return way[::-1]


def opening(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n"


CLOSING = "<|im_end|>\n"


def empty(role: int) -> str:
    return opening(role) + CLOSING


def plain(text: str | None) -> str:
    return (text or "").replace("<|im_", "<| im_")


def _blocks(turns: DataFrame) -> DataFrame:
    """The rows with ``rank``, their number within the conversation, and ``block``."""
    # Equal rows may take any order; the last key lets them spread over ranges.
    order = ["conv_id", "turn", "role", F.xxhash64("text"), "spread"]
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("spread"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("spread").withColumn("range", F.spark_partition_id())

    def number(batches):
        now, count = (), 0
        for batch in batches:
            places = []
            for conv in batch.column(0).to_pylist():
                if conv != now:
                    now, count = conv, 0
                places.append(count)
                count += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], ["conv_id", "turn", "role", "text", "range", "place"])

    placed = cut(arrow_pass(dealt, number, "conv_id bigint, turn bigint, role string, text string, range int, place bigint"), "chat-rows")
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("conv_id", "range").agg((F.max("place") + 1).alias("n")).withColumn("before", F.sum("n").over(earlier))
    # Only the first conversation of a range can have begun before it.
    begun = cut(counts.where("before > 0").select(F.col("conv_id").alias("begun"), "range", "before"), "chat-ranges")
    rank = F.col("place") + F.when(F.col("conv_id").eqNullSafe(F.col("begun")), F.coalesce("before", F.lit(0))).otherwise(0)
    return placed.join(F.broadcast(begun), "range", "left").withColumn("rank", rank).select(
        "conv_id", F.floor(F.col("rank") / BLOCK).alias("block"), "rank", "turn", "role", "text")


def _groups(batches, width: int):
    """Runs of rows with equal first ``width`` values in sorted batches: the values and an iterator that must be used up."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    row = next(rows, None)
    while row is not None:
        key = row[:width]

        def same(first=row):
            nonlocal row
            row = first
            while row is not None and row[:width] == key:
                yield row[width:]
                row = next(rows, None)

        yield key, same()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _flushed(rows, schema: str, size: int = 2000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    yield _batch(held, schema)


def plan(blocks: DataFrame) -> DataFrame:
    """conv_id, block, ``begin`` and ``end`` state, ``last`` (the conversation ends here) and ``cost`` of the conversation."""
    matrices, ways = "conv_id bigint, block bigint, matrix array<bigint>", "conv_id bigint, block bigint, begin int, end int, last boolean, cost bigint"

    def summarise(batches):
        def rows():
            for (conv, block), turns in _groups(batches, 2):
                costs = [[0 if s == t else FAR for s in range(4)] for t in range(4)]
                for _, role in turns:
                    role = role_of(role)
                    costs = [step(c, role) for c in costs]
                yield conv, block, [x for c in costs for x in c]
        yield from _flushed(rows(), matrices)

    def chain(batches):
        def rows():
            for (conv,), parts in _groups(batches, 1):
                costs, entries, found = [0, FAR, FAR, FAR], [], []
                for block, matrix in parts:
                    entries.append(costs)
                    found.append((block, matrix))
                    costs = [min(costs[s] + matrix[4 * s + t] for s in range(4)) for t in range(4)]
                total = [costs[s] + INSERT * len(ENDS[s]) for s in range(4)]
                end = total.index(min(total))
                cost, out = total[end], []
                for k in range(len(found) - 1, -1, -1):
                    block, matrix = found[k]
                    ways_in = [entries[k][s] + matrix[4 * s + end] for s in range(4)]
                    begin = ways_in.index(min(ways_in))
                    out.append((conv, block, begin, end, k == len(found) - 1, cost))
                    end = begin
                yield from out
        yield from _flushed(rows(), ways)

    narrow = blocks.select("conv_id", "block", "rank", "role").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "rank")
    costs = arrow_pass(narrow, summarise, matrices)
    return arrow_pass(costs.repartition("conv_id").sortWithinPartitions("conv_id", "block"), chain, ways)


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, block, seq, turn, role, ``final_role``, ``action`` (keep, merge, relabel, relabel+merge), ``inserted`` empty turns, ``piece``, ``cost``."""
    schema = "conv_id bigint, block bigint, seq bigint, turn bigint, role string, final_role string, action string, inserted int, piece string, cost bigint"
    blocks = _blocks(turns)
    ways = cut(plan(blocks), "chat-plan")
    none = F.lit(None)
    marks = ways.select("conv_id", "block", F.lit(0).alias("kind"), none.cast("long").alias("rank"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), "begin", "end", "last", "cost")
    rows = blocks.select("conv_id", "block", F.lit(1).alias("kind"), "rank", "turn", "role", "text", none.cast("int").alias("begin"), none.cast("int").alias("end"), none.cast("boolean").alias("last"), none.cast("long").alias("cost"))
    dealt = marks.union(rows).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "kind", "rank")

    def render(batches):
        def lines():
            for (conv, block), members in _groups(batches, 2):
                *_, begin, end, last, cost = next(members)
                held = [(turn, role, text) for _, _, turn, role, text, *_ in members]
                for seq, ((turn, role, text), (before, after, merged)) in enumerate(zip(held, repair([role_of(r) for _, r, _ in held], begin, end))):
                    fill = () if merged else WAYS[before, after]
                    piece = "\n" if merged else (CLOSING if before != START else "") + "".join(map(empty, fill)) + opening(after)
                    piece += plain(text)
                    inserted = len(fill)
                    if last and seq == len(held) - 1:
                        piece += CLOSING + "".join(map(empty, ENDS[after]))
                        inserted += len(ENDS[after])
                    action = "+".join((["relabel"] if role_of(role) != after else []) + (["merge"] if merged else [])) or "keep"
                    yield conv, block, seq, turn, role, ROLES[after], action, inserted, piece, cost
        yield from _flushed(lines(), schema)

    return arrow_pass(dealt, render, schema)

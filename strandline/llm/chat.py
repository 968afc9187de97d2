"""Conversations repaired to legal role sequences at least cost, and rendered.

Legal conversations are walks of an automaton: an optional system turn, then
user and assistant in turn, ending with an assistant.  Every message gets a role;
it may keep or change its own (``RELABEL``), join the turn before it when that has
the same role (``MERGE``), and empty turns may be put in where the automaton needs
one (``INSERT`` each).  Dynamic programming over the automaton's states finds the
cheapest repair; of equally cheap ones, walking back from the end, the state that
comes first in ``STATES`` is taken.

A conversation of at most ``block`` messages is repaired by one task.  A longer one
is sorted by range into blocks.  Costs through a block form a small matrix, and
matrices multiply in (min, +), so three passes over the blocks in parallel, with
scans over the few numbers of each block in between, give the very result of the
sequential program, whatever the block size.

Messages are ordered by turn, then role, then text; equal messages are equal.
The result has one row per message; joining ``rendered`` in the order of
(turn_out, turn, source_role, text) gives the chat.

Defined cases: rows without ``conv_id`` form one conversation.  A null turn comes
first.  A null or unknown role fits no state and pays for any.  Null text is
empty text; an empty message is kept.  Repeated rows are messages of their own.
Markers that occur in a text are escaped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import in_arrow, per_group
from strandline.session import materialise

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = ("start", "system", "user", "assistant")
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ACCEPT = (ASSISTANT,)
NAMES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
MERGE, RELABEL, INSERT = 1, 4, 2
NEVER = 1 << 60
BLOCK = 1_024
OPEN, CLOSE, GLUE = "<|{}|>\n", "<|end|>\n", "\n\n"


def walks(first: int) -> dict[int, tuple[int, ...]]:
    """State -> empty turns needed between ``first`` and a new turn of that state, fewest first."""
    out: dict[int, tuple[int, ...]] = {}
    edge = [(s, ()) for s in NEXT[first]]
    while edge:
        fresh = []
        for state, between in edge:
            if state not in out:
                out[state] = between
                fresh += [(s, (*between, state)) for s in NEXT[state]]
        edge = fresh
    return out


def moves() -> list[list[tuple[int, bool, tuple[int, ...]]]]:
    """From state to state: (cost, joins the turn before, empty turns put in)."""
    table = []
    for s in range(4):
        reach = walks(s)
        row = []
        for t in range(4):
            options = [(INSERT * len(reach[t]), False, reach[t])] if t in reach else []
            if s == t != START:
                options.append((MERGE, True, ()))
            row.append(min(options, key=lambda o: (o[0], not o[1])) if options else (NEVER, False, ()))
        table.append(row)
    return table


MOVES = moves()
CLOSING = [min(((INSERT * len(w) + INSERT, (*w, a)) for a in ACCEPT for w in [walks(s).get(a)] if w is not None), default=(NEVER, ())) for s in range(4)]
CLOSING = [(0, ()) if s in ACCEPT else c for s, c in enumerate(CLOSING)]


def role_number(role: str | None) -> int:
    """State that a role names; START stands for none."""
    return NAMES.get((role or "").strip().lower(), START)


def step_costs(role: int) -> list[list[int]]:
    return [[min(NEVER, MOVES[s][t][0] + (0 if t == role else RELABEL)) for t in range(4)] for s in range(4)]


STEPS = [step_costs(r) for r in range(4)]
BEGIN = [0, NEVER, NEVER, NEVER]


def forward(costs: list[int], role: int) -> tuple[list[int], list[int]]:
    """Costs after one more message, and for each state the first cheapest state before it."""
    step, after, back = STEPS[role], [], []
    for t in range(4):
        best, at = min((costs[s] + step[s][t], s) for s in range(4))
        after.append(min(best, NEVER))
        back.append(at)
    return after, back


def last_state(costs: list[int]) -> int:
    return min((costs[s] + CLOSING[s][0], s) for s in range(4))[1]


def trace(roles: list[int], costs: list[int], final: int | None) -> list[int]:
    """State before the first message and after each one."""
    backs = []
    for r in roles:
        costs, back = forward(costs, r)
        backs.append(back)
    states = [last_state(costs) if final is None else final]
    for back in reversed(backs):
        states.append(back[states[-1]])
    return states[::-1]


def clean(text: str | None) -> str:
    return (text or "").replace("<|", "<\\|")


def turn(state: int, body: str = "") -> str:
    return OPEN.format(STATES[state]) + body


def repaired(messages: list[tuple], states: list[int], ends: bool, turns: int) -> list[tuple]:
    """Rows of one block; ``turns`` turns came before it."""
    out = []
    for i, (conv, number, role, text) in enumerate(messages):
        s, t = states[i], states[i + 1]
        _, joins, empty = MOVES[s][t]
        if joins:
            rendered = GLUE + clean(text)
        else:
            rendered = (CLOSE if s != START else "") + "".join(turn(e) + CLOSE for e in empty) + turn(t, clean(text))
            turns += len(empty) + 1
        action = "+".join([*["relabel"] * (role_number(role) != t), *["merge"] * joins, *["insert"] * bool(empty)]) or "keep"
        closing: tuple[int, ...] = ()
        if ends and i == len(messages) - 1:
            closing = CLOSING[t][1]
            rendered += CLOSE + "".join(turn(e) + CLOSE for e in closing)
        inserted = ",".join(STATES[e] for e in (*empty, *closing))
        out.append((conv, number, role, STATES[t], action, inserted, turns - 1, rendered))
    return out


OUT = "conv_id long, turn long, source_role string, role string, action string, inserted string, turn_out long, rendered string"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=names)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in their first ``keys`` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def repair(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """One repaired and rendered row per message."""
    rows = turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col(conv_col).cast("string")), F.lit("-")).alias("key"),
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).alias("role"),
        F.col(text_col).alias("text"),
    )
    long = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block), "long-chats")
    order = ["turn", "role", "text"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _groups(batches, 1):
            messages = [row[1:] for row in group]
            out += repaired(messages, trace([role_number(m[2]) for m in messages], BEGIN, None), True, 0)
            if len(out) >= block:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    total = long.agg(F.sum("n")).first()[0]
    if not total:
        return in_arrow(rows.repartition("key").sortWithinPartitions("key", *order), whole, OUT)
    # as many rows as there are conversations of more than a block
    short = in_arrow(rows.join(long, "key", "left_anti").repartition("key").sortWithinPartitions("key", *order), whole, OUT)
    return short.unionByName(_long(rows.join(long.select("key"), "key", "left_semi"), total, order, block))


def _long(rows: DataFrame, total: int, order: list[str], block: int) -> DataFrame:
    """Conversations cut into blocks by a range sort."""
    parts = max(2, min(10_000, -(-total // (64 * block))))
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, "key", *order, "tie")
    dealt = dealt.sortWithinPartitions("key", *order, "tie").withColumn("place", F.monotonically_increasing_id())
    # places rise along the sort, so a block is a stretch of a conversation
    dealt = materialise(dealt.withColumn("block", F.floor(F.col("place") / block)).drop("tie"), "chat-blocks")
    by_block = lambda df, *columns: df.repartition("key", "block").sortWithinPartitions("key", "block", "place").select("key", "block", *columns)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2):
            lines = []
            for s in range(4):
                costs = [0 if t == s else NEVER for t in range(4)]
                for row in group:
                    costs, _ = forward(costs, role_number(row[2]))
                lines += costs
            yield pa.RecordBatch.from_arrays([pa.array([group[0][0]]), pa.array([group[0][1]]), pa.array([lines])], names=["key", "block", "costs"])

    through = materialise(in_arrow(by_block(dealt, "role"), matrices, "key string, block long, costs array<long>"), "chat-matrices")

    def entries(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("block").to_pylist(), table.column("costs").to_pylist()))
        costs, out = BEGIN, []
        for _, matrix in rows:
            out.append(costs)
            costs = [min(NEVER, min(costs[s] + matrix[4 * s + t] for s in range(4))) for t in range(4)]
        key = table.column("key")[0].as_py()
        return pa.table({"key": [key] * len(rows), "block": [b for b, _ in rows], "entry": out, "exit": [None] * (len(rows) - 1) + [last_state(costs)]},
                        schema=pa.schema([("key", pa.string()), ("block", pa.int64()), ("entry", pa.list_(pa.int64())), ("exit", pa.int32())]))

    entered = materialise(per_group(through, ["key"], entries, "key string, block long, entry array<long>, exit int"), "chat-entries")

    def origins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2):
            costs, came = group[0][2], list(range(4))
            for row in group:
                costs, back = forward(costs, role_number(row[3]))
                came = [came[b] for b in back]
            yield pa.RecordBatch.from_arrays([pa.array([group[0][0]]), pa.array([group[0][1]]), pa.array([came], pa.list_(pa.int32()))], names=["key", "block", "came"])

    with_entry = dealt.join(entered.select("key", "block", "entry"), ["key", "block"])
    traced = in_arrow(by_block(with_entry, "entry", "role"), origins, "key string, block long, came array<int>")
    traced = materialise(traced.join(entered, ["key", "block"]), "chat-origins")

    def exits(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("block").to_pylist(), table.column("came").to_pylist(), table.column("entry").to_pylist(), table.column("exit").to_pylist()))
        state, out = rows[-1][3], []
        for number, came, entry, _ in reversed(rows):
            out.append((number, entry, state, number == rows[-1][0]))
            state = came[state]
        key = table.column("key")[0].as_py()
        return pa.table({"key": [key] * len(out), "block": [o[0] for o in out], "entry": [o[1] for o in out], "exit": [o[2] for o in out], "ends": [o[3] for o in out]},
                        schema=pa.schema([("key", pa.string()), ("block", pa.int64()), ("entry", pa.list_(pa.int64())), ("exit", pa.int32()), ("ends", pa.bool_())]))

    plan = materialise(per_group(traced, ["key"], exits, "key string, block long, entry array<long>, exit int, ends boolean"), "chat-exits")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2):
            key, number, entry, final, ends = group[0][:5]
            messages = [row[5:] for row in group]
            states = trace([role_number(m[2]) for m in messages], entry, final)
            made = _batch(repaired(messages, states, ends, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(messages)), pa.array([number] * len(messages)), *made.columns], names=["key", "block", *made.schema.names]
            )

    full = by_block(dealt.join(plan, ["key", "block"]), "entry", "exit", "ends", "conv_id", "turn", "role", "text")
    done = materialise(in_arrow(full, render, f"key string, block long, {OUT}"), "chat-rendered")
    counts = materialise(done.groupBy("key", "block").agg((F.max("turn_out") + 1).alias("n")), "chat-turns")

    def offsets(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("block").to_pylist(), table.column("n").to_pylist()))
        before, out = 0, []
        for _, n in rows:
            out.append(before)
            before += n
        return pa.table({"key": [table.column("key")[0].as_py()] * len(rows), "block": [b for b, _ in rows], "before": out})

    shift = per_group(counts, ["key"], offsets, "key string, block long, before long")
    names = [f.split()[0] for f in OUT.split(", ")]
    return done.join(shift, ["key", "block"]).withColumn("turn_out", F.col("turn_out") + F.col("before")).select(*names)

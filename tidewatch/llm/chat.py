"""Chat formatting: role sequences repaired at the least cost, then rendered.

The legal orders of roles are an automaton: an optional system message, then user and assistant in turn, from the user on. Each turn is
kept, merged into the message before (same role), relabelled, relabelled and merged, or an empty message is inserted before it; the costs are
parameters. Dynamic programming over the automaton's states finds the cheapest repair; among equal costs, the earlier choice in the order above
and of roles, from the end backwards.

A conversation of any length is split into runs of about sqrt(n) turns. A run is a table of costs from each state before it to each after it
(min-plus); chaining the tables along a conversation gives the least cost of each state before each run. From these, each run tells
which state before it leads to each state after it, by the rule for equal costs above; following that from the last run to the first
gives the states between runs, and each run is then repaired on its own. The repair is the same as of the whole at once
(costs that aren't whole numbers may differ in rounding). Nor is a conversation rendered in one cell: each turn has its
fragment, and the fragments in order are the rendered conversation.

Nulls: a null or unknown role must be relabelled; a null text is empty; turns with a null number come first; rows of a null
conv_id are one conversation. Turns of one number are ordered by role, then by the first HEAD_CHARS characters of the text, then by a hash
of it; repeated rows are separate turns. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import look_up, materialize, with_position

#: States are what came last; the first stands for nothing yet.
STATES = ("start", "system", "user", "assistant")
#: What may follow each state.
LEGAL = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
ROLES = STATES[1:]
COSTS = {"keep": 0, "merge": 2, "relabel": 3, "relabel+merge": 4, "insert": 5}
HEAD, TAIL = "<|im_start|>{}\n", "<|im_end|>\n"
#: Characters of a text that order turns of one number: samples of the order, which go to the driver, hold no whole texts.
HEAD_CHARS = 64
_FAR = float("inf")


def moves(before: str, role: str | None, costs=COSTS) -> list[tuple[float, str, str, str | None]]:
    """(cost, action, role that the turn gets, inserted role) for a turn after a state."""
    out: list[tuple[float, str, str, str | None]] = []
    if role in LEGAL[before]:
        out.append((costs["keep"], "keep", role, None))
    if role == before:
        out.append((costs["merge"], "merge", role, None))
    for other in ROLES:
        if other != role and other in LEGAL[before]:
            out.append((costs["relabel"], "relabel", other, None))
        if other != role and other == before:
            out.append((costs["relabel+merge"], "relabel+merge", other, None))
    if role in ROLES:
        out += [(costs["insert"], "insert", role, q) for q in LEGAL[before] if role in LEGAL[q]]
    return out


class Repair:
    def __init__(self, costs=COSTS):
        self.moves = {(s, r): moves(s, r, costs) for s in STATES for r in (*ROLES, None)}

    def forward(self, best: dict[str, float], roles: list[str | None]) -> tuple[dict[str, float], list[dict[str, tuple]]]:
        """Least cost of each state at the end, from the costs of the states before, and for each turn the best way into each
        state: (state before, move)."""
        back = []
        for role in roles:
            after: dict[str, float] = {}
            ways: dict[str, tuple] = {}
            for before in STATES:
                if before in best:
                    for move in self.moves[before, role]:
                        cost = best[before] + move[0]
                        if cost < after.get(move[2], _FAR):
                            after[move[2]], ways[move[2]] = cost, (before, move)
            best = after
            back.append(ways)
        return best, back

    def repair(self, best: dict[str, float], roles: list[str | None], last: str | None = None) -> tuple[str, list[tuple]]:
        """The state before, and the moves, of the cheapest repair to a state (None: the cheapest end)."""
        end, back = self.forward(best, roles)
        state = last or min(STATES, key=lambda s: end.get(s, _FAR))
        out = []
        for ways in reversed(back):
            state, move = ways[state]
            out.append(move)
        return state, out[::-1]


def fragment(move: tuple, text: str, at_start: bool, at_end: bool) -> str:
    """What a turn adds to the rendered conversation."""
    _, action, role, inserted = move
    if action.endswith("merge"):
        out = "\n"
    else:
        out = "" if at_start else TAIL
        if inserted:
            out += HEAD.format(inserted) + TAIL
        out += HEAD.format(role)
    return out + text + (TAIL if at_end else "")


OUT = "conv_id long, turn long, position long, role string, action string, new_role string, inserted_role string, cost double, rendered string"


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """The rows of each (conv_id, run), which come together; a run has about sqrt(n) rows."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for _, run in groupby(rows, key=lambda r: r[:width]):
        yield list(run)


def _known(role: str | None) -> str | None:
    return role if role in ROLES else None


def _in_order(turns: DataFrame, size: int) -> DataFrame:
    """Adds n (turns of the conversation), position (from 0 along it) and run (of size positions)."""
    keyed = turns.withColumn("_row", F.monotonically_increasing_id())
    keys = (F.col("conv_id"), F.col("turn"), F.col("role"), F.substring("text", 1, HEAD_CHARS), F.xxhash64("text"), F.col("_row"))
    order = [k.asc_nulls_first() for k in keys]
    rows = materialize(with_position(keyed, order, "_at", "turns-ranges").drop("_row"), "turns-placed")
    # a key that is never null, also apart from all numbers
    rows = rows.withColumn("_key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    totals = materialize(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first")).withColumn("turns", F.col("n")), "turn-counts")
    rows = look_up(rows, totals.select("_key", "n", "_first", "turns"), "_key", "n", turns.count())
    position = F.col("_at") - F.col("_first")
    return rows.select("conv_id", F.floor(position / size).alias("run"), position.alias("position"), "turn", "role", "text", F.col("turns").alias("n"))


KNOWN = "array<double>"


def repair_conversations(conversations: DataFrame, costs=COSTS) -> DataFrame:
    """Each turn with its action, new role, inserted role, cost and rendered fragment."""
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.coalesce("text", F.lit("")).alias("text"))
    turns = materialize(turns, "turns")
    size = max(64, int(turns.count() ** 0.5))
    ranked = materialize(_in_order(turns, size), "turns-ranked")
    together = lambda df: df.repartition("conv_id", "run").sortWithinPartitions("conv_id", "run", "position")
    along = lambda df: df.repartition("conv_id").sortWithinPartitions("conv_id", "run")

    def batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names)

    # conversations of one run need no chain
    long = ranked.where(F.col("n") > size).select("conv_id", "run", "position", "role")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dp, out = Repair(costs), []
        for rows in _runs(batches, 2):
            roles = [_known(r[3]) for r in rows]
            out.append((*rows[0][:2], [[dp.forward({s: 0.0}, roles)[0].get(e, _FAR) for e in STATES] for s in STATES]))
        yield batch(out, ["conv_id", "run", "costs"], [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.float64()))])

    def costs_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 1):
            best, out = [0.0, *[_FAR] * (len(STATES) - 1)], []
            for r in rows:
                out.append((*r[:2], best))
                best = [min(b + table[e] for b, table in zip(best, r[2], strict=True)) for e in range(len(STATES))]
            yield batch(out, ["_conv", "_run", "before"], [pa.int64(), pa.int64(), pa.list_(pa.float64())])

    chained = together(long).mapInArrow(tables, f"conv_id long, run long, costs array<{KNOWN}>")
    before = materialize(along(chained).mapInArrow(costs_before, f"_conv long, _run long, before {KNOWN}"), "run-costs")
    same_run = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("run") == F.col("_run"))
    known = lambda values: {s: v for s, v in zip(STATES, values, strict=True) if v < _FAR}

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dp, out = Repair(costs), []
        for rows in _runs(batches, 2):
            end, back = dp.forward(known(rows[0][4]), [_known(r[3]) for r in rows])
            from_state = []
            for e in STATES:
                state = e if e in end else None
                for step in reversed(back if state else []):
                    state = step[state][0]
                from_state.append(state)
            out.append((*rows[0][:2], rows[0][4], [end.get(e, _FAR) for e in STATES], from_state))
        yield batch(out, ["conv_id", "run", "before", "after", "from_state"], [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.string())])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 1):
            end, out = min(range(len(STATES)), key=lambda e: rows[-1][3][e]), []
            for r in reversed(rows):
                out.append((*r[:3], STATES[end]))
                end = STATES.index(r[4][end])
            yield batch(out, ["_conv", "_run", "before", "last"], [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.string()])

    reached = together(long.join(before, same_run).select("conv_id", "run", "position", "role", "before")).mapInArrow(ways, f"conv_id long, run long, before {KNOWN}, after {KNOWN}, from_state array<string>")
    between = materialize(along(reached).mapInArrow(ends, f"_conv long, _run long, before {KNOWN}, last string"), "run-ends")
    rows = ranked.join(between, same_run, "left").select("conv_id", "run", "position", "turn", "role", "text", "n", "before", "last")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()]
    names = [x.split()[0] for x in OUT.split(", ")]

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dp = Repair(costs)
        for rows in _runs(batches, 2):
            _, found = dp.repair(known(rows[0][7]) if rows[0][7] else {"start": 0.0}, [_known(r[4]) for r in rows], rows[0][8])
            yield batch([(r[0], r[3], r[2], r[4], m[1], m[2], m[3], float(m[0]), fragment(m, r[5], r[2] == 0, r[2] == r[6] - 1)) for r, m in zip(rows, found, strict=True)], names, kinds)

    return together(rows).mapInArrow(repair, OUT)


def render(repaired: DataFrame) -> DataFrame:
    """conv_id, cost and the whole rendered conversation, for conversations that fit in a cell."""
    parts = F.array_sort(F.collect_list(F.struct("position", "rendered")))
    return repaired.groupBy("conv_id").agg(F.sum("cost").alias("cost"), parts.alias("_parts")).select("conv_id", "cost", F.array_join(F.transform("_parts", lambda p: p["rendered"]), "").alias("rendered"))

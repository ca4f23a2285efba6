"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, beginning with a user and
ending with an assistant. Each given turn may begin a turn of its role or another (RELABEL; SYSTEM more to or from it), after empty turns that make
it legal (INSERT each), or be merged into the turn before (MERGE). Dynamic programming over the automaton's states finds
the cheapest repair; among equal ones the smallest state goes back first, then the option listed first. By these costs each
repair has its place: two turns of a role are merged, the middle one of three is relabelled, a missing first or last turn
is inserted.

A text can't forge a turn: "<|" is rendered as "<\\|", and a backslash after "<" is doubled; `unescaped` undoes it.

Conversations are cut into pieces of PIECE turns. A piece is a min-plus matrix from its first to its last state; the
matrices of a conversation are chained, which fixes each piece's end states, and the pieces are then repaired on their
own. So no task needs a whole conversation, however long.

The result has a row for each given turn, with its part of the rendered text: the parts of a conversation, in order of
`position`, joined, are the repaired conversation. Turns stand by turn (null first), then role and text. Null or unknown
roles are relabelled at the usual cost; null text is empty. Repeated rows are turns of their own. Null conv_id is a
conversation. Empty tables give none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspar.llm.common import column, whole_groups
from quillspar.session import write_table

MERGE, RELABEL, SYSTEM, INSERT, PIECE = 2, 3, 1, 3, 4096
ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn.
START, NEVER = 0, 1 << 40
#: What may follow each state, and the empty turns to be put before a role that may not.
NEXT = {0: ("system", "user"), 1: ("user",), 2: ("assistant",), 3: ("user",)}
PADDING = {("user", 2): ("assistant",), ("assistant", 0): ("user",), ("assistant", 1): ("user",), ("assistant", 3): ("user",)}
#: Empty turns, by state, that make a conversation end legally.
CLOSING = {0: (), 1: ("user", "assistant"), 2: ("assistant",), 3: ()}


def options(role: str | None, state: int) -> list[tuple[int, int, str, str, tuple[str, ...]]]:
    """(cost, next state, action, role, empty turns before) for a given turn in a state."""
    found = []
    for to in sorted(ROLES, key=lambda r: r != role):
        changed = 0 if to == role else RELABEL + SYSTEM * ("system" in (to, role))
        end = ROLES.index(to) + 1
        if to in NEXT[state]:
            found.append((changed, end, "relabel" if changed else "keep", to, ()))
        elif (to, state) in PADDING:
            found.append((changed + INSERT, end, "relabel" if changed else "keep", to, PADDING[to, state]))
        if state == end:
            found.append((changed + MERGE, end, "merge", to, ()))
    return found


def _best(role: str | None) -> tuple[np.ndarray, dict[tuple[int, int], tuple]]:
    costs, how = np.full((4, 4), NEVER, np.int64), {}
    for state in range(4):
        for option in options(role, state):
            if option[0] < costs[state, option[1]]:
                costs[state, option[1]], how[state, option[1]] = option[0], option
    return costs, how


STEPS = {role: _best(role) for role in (*ROLES, None)}


def step(role: str | None) -> tuple[np.ndarray, dict]:
    return STEPS[role if role in ROLES else None]


def matrix(roles: list[str | None]) -> np.ndarray:
    """Least cost from each state before the turns to each state after them."""
    total = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for role in roles:
        total = np.minimum((total[:, :, None] + step(role)[0][None]).min(axis=1), NEVER)
    return total


def repair(roles: list[str | None], entry: int, last: int) -> list[tuple]:
    """The options taken, one for each turn, on the cheapest way from one state to another."""
    costs = [np.where(np.arange(4) == entry, 0, NEVER)]
    for role in roles:
        costs.append(np.minimum((costs[-1][:, None] + step(role)[0]).min(axis=0), NEVER))
    taken, state = [], last
    for k in range(len(roles) - 1, -1, -1):
        ways, how = step(roles[k])
        before = int(np.argmin(costs[k] + ways[:, state]))
        taken.append(how[before, state])
        state = before
    return taken[::-1]


def ends(matrices: list[np.ndarray]) -> tuple[int, list[tuple[int, int]]]:
    """The least cost of a conversation of such pieces, and each piece's first and last state."""
    costs = [np.where(np.arange(4) == START, 0, NEVER)]
    for m in matrices:
        costs.append(np.minimum((costs[-1][:, None] + m).min(axis=0), NEVER))
    closing = np.array([INSERT * len(CLOSING[s]) for s in range(4)])
    state = int(np.argmin(costs[-1] + closing))
    total, out = int((costs[-1] + closing)[state]), []
    for k in range(len(matrices) - 1, -1, -1):
        before = int(np.argmin(costs[k] + matrices[k][:, state]))
        out.append((before, state))
        state = before
    return total, out[::-1]


def escaped(text: str) -> str:
    return re.sub(r"<([\\|])", r"<\\\1", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\([\\|])", r"<\1", text)


def opened(role: str, text: str = "") -> str:
    return f"<|{role}|>\n{escaped(text)}"


END = "<|end|>\n"


def segments(turns: list[tuple[str | None, str]], entry: int, last: int, final: bool) -> list[dict]:
    """Per turn: action, new role, empty turns before, and its part of the rendered text."""
    out, state = [], entry
    for (_, text), (_, after, action, role, before) in zip(turns, repair([r for r, _ in turns], entry, last), strict=True):
        if action == "merge":
            part = "\n" + escaped(text)
        else:
            part = (END if state != START else "") + "".join(opened(r) + END for r in before) + opened(role, text)
        out.append({"action": action, "new_role": role, "inserted": ",".join(before), "segment": part})
        state = after
    if final and out:
        out[-1]["segment"] += "".join(END + opened(r) for r in CLOSING[state]) + END
        out[-1]["closing"] = ",".join(CLOSING[state])
    return out


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for several in whole_groups(batches, "piece"):
        for part in _pieces(several):
            yield pa.RecordBatch.from_pydict({"conv": pa.array([part["conv"][0]]), "number": pa.array([part["number"][0]]), "costs": pa.array([matrix(part["role"]).ravel().tolist()], pa.list_(pa.int64()))})


def _pieces(table: pa.Table, names: tuple[str, ...] = ("conv", "number", "role")) -> Iterator[dict[str, list]]:
    piece = column(table, "piece").to_pylist()
    columns = {n: column(table, n).to_pylist() for n in names}
    first = 0
    for k in range(1, len(piece) + 1):
        if k == len(piece) or piece[k] != piece[first]:
            yield {n: v[first:k] for n, v in columns.items()}
            first = k


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, "conv"):
        rows = table.to_pylist()
        first = 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or rows[k]["conv"] != rows[first]["conv"]:
                own = rows[first:k]
                total, states = ends([np.array(r["costs"], np.int64).reshape(4, 4) for r in own])
                columns = {"conv": [r["conv"] for r in own], "number": [r["number"] for r in own], "entry": [a for a, _ in states], "last": [b for _, b in states], "final": [i == len(own) - 1 for i in range(len(own))], "conv_cost": [total] * len(own)}
                yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.string() if n == "conv" else pa.bool_() if n == "final" else pa.int64()) for n, v in columns.items()})
                first = k


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("conv", "position", "role", "text", "entry", "last", "final")
    for table in whole_groups(batches, "piece"):
        rows = []
        for part in _pieces(table, names):
            rows += segments([(r, t or "") for r, t in zip(part["role"], part["text"], strict=True)], part["entry"][0], part["last"][0], part["final"][0])
        kept = [column(table, n) for n in ("conv_id", "turn", "position", "role", "conv_cost")]
        made = [pa.array([r.get(n, "") for r in rows], pa.string()) for n in ("new_role", "action", "inserted", "closing", "segment")]
        yield from pa.table([*kept, *made], names=["conv_id", "turn", "position", "role", "conv_cost", "new_role", "action", "inserted", "closing", "segment"]).to_batches()


def repaired(conversations: DataFrame) -> DataFrame:
    """Per given turn: conv_id, turn, position, role, new_role, action, inserted, closing, segment, conv_cost."""
    kinds = dict(conversations.dtypes)
    turns = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = turns.withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    # rows alike in all columns are dealt by a number, so that many copies of a turn don't make one task
    turns = turns.withColumn("_tie", F.monotonically_increasing_id())
    order = ["conv", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first(), "_tie"]
    n = max(2, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = turns.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_tie").withColumn("at", F.monotonically_increasing_id())
    placed = write_table(placed, "turns").withColumn("task", F.shiftrightunsigned("at", 33))
    runs = placed.groupBy("conv", "task").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = write_table(runs.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))), "runs")
    placed = placed.join(runs.select("conv", "task", "first", "offset"), ["conv", "task"])
    placed = placed.withColumn("position", F.col("at") - F.col("first") + F.col("offset")).withColumn("number", F.floor(F.col("position") / PIECE).cast("long"))
    placed = write_table(placed.select("conv_id", "turn", "role", "text", "conv", "position", "number", F.concat_ws("#", "number", "conv").alias("piece")), "placed")
    costs = placed.select("conv", "number", "piece", "position", "role").repartition(n, "piece").sortWithinPartitions("piece", "position")
    costs = write_table(costs.mapInArrow(_matrices, "conv string, number long, costs array<long>"), "costs")
    states = costs.repartition(n, "conv").sortWithinPartitions("conv", "number").mapInArrow(_chained, "conv string, number long, entry long, last long, final boolean, conv_cost long")
    states = write_table(states, "states")
    whole = placed.join(states, ["conv", "number"]).repartition(n, "piece").sortWithinPartitions("piece", "position")
    return whole.mapInArrow(_repaired, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, position long, role string, conv_cost long, new_role string, action string, inserted string, closing string, segment string")


def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, text) from `repaired`, for conversations that fit in a row."""
    parts = F.array_sort(F.collect_list(F.struct("position", "segment")))
    return turns.groupBy("conv_id").agg(F.concat_ws("", F.transform(parts, lambda p: p["segment"])).alias("text"))

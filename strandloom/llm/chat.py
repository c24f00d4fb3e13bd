"""Chat formatting by minimum-cost role repair."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, table

ROLES = ("system", "user", "assistant")
#: Other names of roles; any other name is unknown.
SYNONYMS = {
    "system": "system", "developer": "system", "user": "user", "human": "user", "prompter": "user",
    "assistant": "assistant", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant",
}
MERGE, RELABEL, NAME_UNKNOWN, INSERT = 1.0, 2.0, 1.0, 3.0
#: Turns of a conversation are worked through in spans of so many turn numbers.
SPAN = 512
#: Turns that one group of spans gathers, at most about so many.
GROUP_ROWS = 8_000
START = 0  # states: 0 at the start, then after a message of ROLES[state - 1]
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}


def _step_costs(role: str | None) -> dict[tuple[int, int], tuple[float, str, tuple[int, ...]]]:
    """For a turn of this role: (state, next state) -> cost, action, roles inserted before."""
    role = SYNONYMS.get((role or "").strip().lower())
    out: dict = {}
    for state in range(4):
        for to in (1, 2, 3):
            base = (NAME_UNKNOWN if role is None else 0.0 if ROLES[to - 1] == role else RELABEL)
            name = "keep" if base == 0 else "relabel"
            ways = []
            if to == state:
                ways.append((base + MERGE, name + "+merge" if base else "merge", ()))
            if to in LEGAL[state]:
                ways.append((base, name, ()))
            for between in LEGAL[state]:
                if to in LEGAL[between]:
                    ways.append((base + INSERT, name + "+insert" if base else "insert", (between,)))
            if ways:
                out[state, to] = min(ways, key=lambda w: w[0])
    return out


_CACHE: dict = {}


def _steps(role):
    key = SYNONYMS.get((role or "").strip().lower()) if isinstance(role, str) else None
    if key not in _CACHE:
        _CACHE[key] = _step_costs(key)
    return _CACHE[key]


def _run(roles) -> tuple[np.ndarray, list[np.ndarray]]:
    """Least cost from each state before these turns to each state after, and the choices that reach it."""
    cost = np.full((4, 4), np.inf)
    np.fill_diagonal(cost, 0.0)
    back = []
    for role in roles:
        now, came = np.full((4, 4), np.inf), np.zeros((4, 4), np.int8)
        for (state, to), (price, _, _) in sorted(_steps(role).items()):
            way = cost[:, state] + price
            better = way < now[:, to]
            now[better, to] = way[better]
            came[better, to] = state
        cost = now
        back.append(came)
    return cost, back


_COSTS = pa.schema([("conv_id", pa.int64()), ("span", pa.int64()), ("cost", pa.list_(pa.float64()))])
_STATES = pa.schema([
    ("conv_id", pa.int64()), ("span", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_()),
    ("conv_cost", pa.float64()),
])
_TURNS = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("place", pa.int32()), ("role_before", pa.string()),
    ("role", pa.string()), ("action", pa.string()), ("cost", pa.float64()), ("text", pa.string()),
    ("rendered", pa.string()), ("conv_cost", pa.float64()),
])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _runs(group: pa.Table, *order: str):
    """Rows of a group by conversation and, if it has turns, span; each run in the order of the other columns."""
    keys = ["conv_id"] + (["span"] if "turn" in group.column_names else [])
    rows = group.to_pylist()
    rows.sort(key=lambda r: tuple((r[c] is None, r[c] if r[c] is not None else 0) for c in (*keys, *order)))
    for key, run in groupby(rows, key=lambda r: tuple(r[c] for c in keys)):
        yield key, list(run)


def _spans(group: pa.Table) -> pa.Table:
    out = [(conv, span, _run([r["role"] for r in rows])[0].ravel().tolist()) for (conv, span), rows in _runs(group, "turn", "role", "text")]
    return _table(out, _COSTS)


def _compose(group: pa.Table) -> pa.Table:
    return _table([x for _, rows in _runs(group, "span") for x in _paths(rows)], _STATES)


def _paths(rows: list[dict]) -> list[tuple]:
    """States at which each span of a conversation is entered and left, on a path of least cost."""
    costs = [np.array(r["cost"], dtype=float).reshape(4, 4) for r in rows]
    best, came = np.array([0.0, np.inf, np.inf, np.inf]), []
    for c in costs:
        way = best[:, None] + c
        came.append(way.argmin(0))
        best = way.min(0)
    state, path = int(best.argmin()), []
    total = float(best.min())
    for k in range(len(costs) - 1, -1, -1):
        before = int(came[k][state])
        path.append((before, state))
        state = before
    path.reverse()
    return [(r["conv_id"], r["span"], a, b, k == len(costs) - 1, total) for k, (r, (a, b)) in enumerate(zip(rows, path, strict=True))]


def _decode(left: pa.Table, right: pa.Table) -> pa.Table:
    states = {(r["conv_id"], r["span"]): r for r in right.to_pylist()}
    return _table([x for key, rows in _runs(left, "turn", "role", "text") for x in _rendered(rows, states[key])], _TURNS)


def _rendered(rows: list[dict], known: dict) -> list[tuple]:
    enter, state, last, total = known["enter"], known["leave"], known["last"], known["conv_cost"]
    _, back = _run([r["role"] for r in rows])
    states = [state]
    for came in reversed(back):
        state = int(came[enter, state])
        states.append(state)
    states.reverse()
    out = []
    for k, row in enumerate(rows):
        before, after = states[k], states[k + 1]
        price, action, inserted = _steps(row["role"])[before, after]
        text = row["text"] or ""
        if "merge" in action:
            rendered = "\n" + text
        else:
            rendered = "" if before == START else "<|im_end|>\n"
            for between in inserted:
                rendered += f"<|im_start|>{ROLES[between - 1]}\n<|im_end|>\n"
            rendered += f"<|im_start|>{ROLES[after - 1]}\n{text}"
        if last and k == len(rows) - 1:
            rendered += "<|im_end|>\n"
        out.append((row["conv_id"], row["turn"], k, row["role"], ROLES[after - 1], action, price, text, rendered, total))
    return out


SCHEMA = "conv_id long, turn long, place int, role_before string, role string, action string, cost double, text string, rendered string, conv_cost double"


def repair(conversations: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per turn: the role after repair, what was done, its cost, and its part of the rendered conversation.

    Legal: at most one system message, first; then user and assistant in turn,
    user first. A turn keeps its role, is relabelled, is merged with the message
    before, or gets an empty message put in before it; of all ways the cheapest is
    taken (ties: the lowest state before). ``rendered`` of the rows in the order of
    (turn, place) joined makes the conversation; ``conv_cost`` is its whole cost.

    The dynamic program runs over spans of turn numbers: each span gives the least
    cost between any two states, the spans of a conversation are composed, and
    then each span is decoded between its two states. So a conversation of any
    length is worked through by many tasks.

    Null or unknown role: relabelled at lower cost. Null text: empty. Null turn: a
    span after the others. Null conv_id: one conversation. Turns with equal numbers
    go by role and text; repeated rows are turns of their own. An empty table gives
    an empty result. Other columns are left out.
    """
    scratch = Scratch(conversations.sparkSession)
    turns = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text",
        F.floor(F.col("turn") / span).cast("long").alias("span"),
    )
    # spans are gathered by hash to groups of bounded size, for each call into Python has its price
    groups = max(1, turns.count() // GROUP_ROWS)
    by_span = F.pmod(F.xxhash64("conv_id", "span"), F.lit(groups)).alias("part")
    costs = turns.groupBy(by_span).applyInArrow(_spans, "conv_id long, span long, cost array<double>")
    states = costs.groupBy(F.pmod(F.xxhash64("conv_id"), F.lit(groups)).alias("part")).applyInArrow(_compose, "conv_id long, span long, enter int, leave int, last boolean, conv_cost double")
    states = scratch.save(states)
    return turns.groupBy(by_span).cogroup(states.groupBy(by_span)).applyInArrow(_decode, SCHEMA)


def op7_chat_formatting(spark, sf_dir):
    return repair(table(spark, sf_dir, "conversations"))

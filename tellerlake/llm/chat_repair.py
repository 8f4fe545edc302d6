"""Chat formatting: the cheapest repair of a conversation's roles, and its rendering."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, pieces, stored, text_bytes

ROLES = ("system", "user", "assistant")
UNKNOWN = 3
#: States of the automaton: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: state -> {role that may come next: state after it}; a conversation ends after an assistant turn.
LEGAL = {START: {0: SYSTEM, 1: USER}, SYSTEM: {1: USER}, USER: {2: ASSISTANT}, ASSISTANT: {1: USER}}
#: Role of the turn that a state stands behind.
SPOKEN = {SYSTEM: 0, USER: 1, ASSISTANT: 2}
NEVER = 1 << 40
#: Turns, and about as many bytes of text, that one task holds.
PART_ROWS, PART_BYTES = 50_000, 32 << 20


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    insert: int = 2
    relabel: int = 3


@dataclass(frozen=True)
class Step:
    """What becomes of one turn: the empty turns put before it, whether it joins the turn before, its role."""

    cost: int
    inserted: tuple[int, ...]
    merged: bool
    role: int


def inserts(costs: Costs) -> dict[tuple[int, int], tuple[int, tuple[int, ...]]]:
    """(from, to) -> cost and roles of the fewest empty turns that lead there."""
    out = {(s, s): (0, ()) for s in range(STATES)}
    for _ in range(STATES):
        for (s, t), (cost, roles) in list(out.items()):
            for role, after in LEGAL[t].items():
                new = (cost + costs.insert, (*roles, role))
                if role != 0 and ((s, after) not in out or new < out[s, after]):  # an empty system turn says nothing
                    out[s, after] = new
    return out


def turn_steps(costs: Costs) -> list[dict[tuple[int, int], Step]]:
    """For each role of an input turn (the last: unknown), (from, to) -> its cheapest step.

    Ties go to the step with fewer insertions, then to a merge, then to the lower role.
    """
    out = []
    for given in range(len(ROLES) + 1):
        best: dict[tuple[int, int], tuple] = {}
        for (s, middle), (cost, roles) in inserts(costs).items():
            options = [(costs.relabel * (role != given), False, role, after) for role, after in LEGAL[middle].items()]
            if middle in SPOKEN and not roles:
                options.append((costs.merge + costs.relabel * (SPOKEN[middle] != given), True, SPOKEN[middle], middle))
            for extra, merged, role, after in options:
                rank = (cost + extra, len(roles), not merged, role, roles)
                if (s, after) not in best or rank < best[s, after][0]:
                    best[s, after] = rank, Step(cost + extra, roles, merged, role)
        out.append({k: v[1] for k, v in best.items()})
    return out


def endings(costs: Costs) -> dict[int, tuple[int, tuple[int, ...]]]:
    """Cost and roles of the empty turns that end a conversation legally from each state."""
    ways = inserts(costs)
    return {s: ways[s, ASSISTANT] for s in range(STATES) if (s, ASSISTANT) in ways}


def matrices(costs: Costs) -> np.ndarray:
    out = np.full((len(ROLES) + 1, STATES, STATES), NEVER, dtype=np.int64)
    for role, steps in enumerate(turn_steps(costs)):
        for (s, t), step in steps.items():
            out[role, s, t] = step.cost
    return out


def tie_weights(ties: np.ndarray) -> np.ndarray:
    """32-bit weight of each turn's step from state to state. Among equally cheap repairs the one with the least sum is
    taken; as the weights come from the turns alone, it does not matter how a conversation is cut."""
    pair = np.arange(STATES * STATES, dtype=np.uint64).reshape(1, STATES, STATES)
    return (mix(ties.astype(np.int64).view(np.uint64)[:, None, None] ^ mix(pair + np.uint64(1))) >> np.uint64(32)).astype(np.int64)


def least(cost: np.ndarray, tie: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest (cost, tie) along an axis, and where it is."""
    low = cost.min(axis=axis, keepdims=True)
    open_ties = np.where(cost == low, tie, np.iinfo(np.int64).max)
    return np.minimum(low.squeeze(axis), NEVER), open_ties.min(axis=axis), open_ties.argmin(axis=axis)


def segment_matrices(roles: np.ndarray, ties: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least cost, and tie weight, from each state to each over every run of turns: (min, +) products, all runs at once."""
    size, weights = np.diff(bounds), tie_weights(ties)
    cost = np.full((len(size), STATES, STATES), NEVER, dtype=np.int64)
    tie = np.zeros_like(cost)
    cost[:, range(STATES), range(STATES)] = 0
    for i in range(int(size.max()) if len(size) else 0):
        own = np.flatnonzero(size > i)
        at = bounds[own] + i
        cost[own], tie[own], _ = least(cost[own][:, :, :, None] + table[roles[at]][:, None, :, :], tie[own][:, :, :, None] + weights[at][:, None, :, :], 2)
    return cost, tie


def walk(entry: int, leave: int | None, costs, ties, close: dict) -> tuple[list[int], int]:
    """States behind each of a chain of (min, +) steps, and the total cost; ``leave`` None ends the conversation."""
    cost, tie = np.full(STATES, NEVER, dtype=np.int64), np.zeros(STATES, dtype=np.int64)
    cost[entry] = 0
    back = []
    for step, weight in zip(costs, ties):
        cost, tie, origin = least(cost[:, None] + step, tie[:, None] + weight, 0)
        back.append(origin)
    if leave is None:
        total, _, state = min((int(cost[s]) + extra, int(tie[s]), s) for s, (extra, _) in close.items())
    else:
        total, state = int(cost[leave]), leave
    path = []
    for origin in reversed(back):
        path.append(state)
        state = int(origin[state])
    return path[::-1], total


def best_path(roles: np.ndarray, ties: np.ndarray, entry: int, leave: int | None, table: np.ndarray, close: dict) -> tuple[list[int], int]:
    """States behind each turn of a run from state ``entry``, and the run's cost."""
    return walk(entry, leave, table[roles], tie_weights(ties), close)


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else UNKNOWN


def segments(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by conversation and place, and the bounds of the conversations in it."""
    order = np.argsort(table["_c_nth"].to_numpy(), kind="stable")
    conversation = table["_c_conv"].to_numpy()[order]
    cut = np.flatnonzero(np.diff(conversation)) + 1
    return order, np.concatenate(([0], cut, [len(order)])) if len(order) else np.zeros(1, np.int64)


SEGMENT = "part long, conv long, conv_first long, rows long, costs array<long>, ties array<long>"
CHOICE = "part long, conv_first long, entry int, leave int, before long, total long, closes boolean"


def summarise(table: np.ndarray):
    """A row for each run of a conversation in a part."""

    def run(rows: pa.Table) -> pa.Table:
        order, bounds = segments(rows)
        roles = np.array([role_number(r) for r in rows["_c_role"].to_pylist()], dtype=np.int64)[order]
        costs, ties = segment_matrices(roles, rows["_c_tie"].to_numpy()[order], bounds, table)
        flat = lambda m: pa.array(m.reshape(-1, STATES * STATES).tolist(), pa.list_(pa.int64()))
        first = order[bounds[:-1]]
        return pa.table({"part": rows["_c_part"].take(pa.array(first)), "conv": rows["_c_conv"].take(pa.array(first)),
                         "conv_first": rows["_c_nth"].take(pa.array(first)), "rows": pa.array(np.diff(bounds), pa.int64()),
                         "costs": flat(costs), "ties": flat(ties)})

    return run


def choose(close: dict):
    """Entry and exit state of every run of one conversation, from its runs' matrices in order."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "ascending"), ("conv_first", "ascending")])
        costs, ties = (np.array(rows[c].to_pylist(), dtype=np.int64).reshape(-1, STATES, STATES) for c in ("costs", "ties"))
        path, total = walk(START, None, costs, ties, close)
        states = [START, *path]
        size = rows["rows"].to_numpy()
        n = len(path)
        return pa.table({"part": rows["part"], "conv_first": rows["conv_first"], "entry": pa.array(states[:-1], pa.int32()),
                         "leave": pa.array(states[1:], pa.int32()), "before": pa.array(np.cumsum(size) - size, pa.int64()),
                         "total": pa.array([total] * n, pa.int64()), "closes": pa.array([i == n - 1 for i in range(n)])})

    return run


@dataclass(frozen=True)
class Template:
    """How turns are written; ``join`` stands between merged turns."""

    open: str = "<|{role}|>\n"
    close: str = "\n<|end|>\n"
    join: str = "\n\n"

    def piece(self, step: Step, text: str, first: bool, ending: tuple[int, ...] | None) -> str:
        """What one input turn adds to the conversation: pieces in order give the whole."""
        if step.merged:
            out = self.join + text
        else:
            out = "" if first else self.close
            out += "".join(self.open.format(role=ROLES[r]) + self.close for r in step.inserted)
            out += self.open.format(role=ROLES[step.role]) + text
        if ending is not None:
            out += self.close + "".join(self.open.format(role=ROLES[r]) + self.close for r in ending)
        return out


def rewrite(costs: Costs, template: Template):
    table, steps, close = matrices(costs), turn_steps(costs), endings(costs)

    def run(rows: pa.Table, choices: pa.Table) -> pa.Table:
        order, bounds = segments(rows)
        roles = np.array([role_number(r) for r in rows["_c_role"].to_pylist()], dtype=np.int64)[order]
        texts = rows["_c_text"].to_pylist()
        nth, ties = rows["_c_nth"].to_numpy()[order], rows["_c_tie"].to_numpy()[order]
        chosen = {c["conv_first"]: c for c in choices.to_pylist()}
        out: dict[str, list] = {n: [] for n in ("position", "new_role", "action", "n_inserted", "cost", "total_cost", "rendered")}
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = chosen.get(int(nth[a])) or {"entry": START, "leave": None, "before": 0, "total": None, "closes": True}
            path, total = best_path(roles[a:b], ties[a:b], own["entry"], own["leave"], table, close)
            state = own["entry"]
            for i in range(a, b):
                step = steps[roles[i]][state, path[i - a]]
                state = path[i - a]
                ends = own["closes"] and i == b - 1
                ending = close[state][1] if ends else None
                place = own["before"] + i - a
                out["position"].append(place)
                out["new_role"].append(ROLES[step.role])
                out["action"].append(("merge" if step.merged else "keep") if step.role == roles[i] else ("relabel and merge" if step.merged else "relabel"))
                out["n_inserted"].append(len(step.inserted) + len(ending or ()))
                out["cost"].append(step.cost + (close[state][0] if ends else 0))
                out["total_cost"].append(own["total"] if own["total"] is not None else total)
                out["rendered"].append(template.piece(step, texts[order[i]] or "", place == 0, ending))
        types = {"position": pa.int64(), "n_inserted": pa.int64(), "cost": pa.int64(), "total_cost": pa.int64()}
        kept = rows.take(pa.array(order))
        return pa.table({**{c: kept[c] for c in ("conv_id", "turn", "role")}, "copies": kept["_c_copies"],
                         **{n: pa.array(v, types.get(n, pa.string())) for n, v in out.items()}})

    return run


def repair(turns: DataFrame, costs: Costs = Costs(), template: Template = Template()) -> DataFrame:
    """One row for each turn of ``turns`` (conv_id, turn, role, text): conv_id, turn, role, copies, position, new_role,
    action, n_inserted, cost, total_cost, rendered.

    A legal conversation has an optional system turn and then user and assistant turns in turn, ending with an
    assistant's. The repair of least total cost may give a turn another role, merge it into the turn before it, or put
    empty turns before it or at the end; equal costs are
    settled by the turns themselves, however they are partitioned. ``rendered`` is what the turn
    adds to the conversation's text: the pieces in order of ``position`` are the whole.

    Turns are ordered by turn, role and text, nulls first. Equal rows count as one turn (``copies``). Roles are
    compared without case and outer blanks; an unknown or null role must be given another. Null texts are empty. A null
    conv_id is a conversation of its own. The dynamic program runs over pieces of conversations: every piece reports a
    matrix of least costs between states, a conversation's few matrices settle its states at the cuts, and the pieces
    are then rewritten, so no conversation is ever held by one task.
    """
    spark = turns.sparkSession
    table, close = matrices(costs), endings(costs)
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("_c_copies"))
    rows = stored(rows.select("*", F.xxhash64("conv_id").alias("_c_conv")), "chat-turns")
    parts = max(pieces(rows.count(), PART_ROWS), pieces(text_bytes(rows), PART_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["_c_conv", "conv_id", "turn", "role", "text"]
    ranged = (rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .select("conv_id", "turn", "role", "_c_conv", "_c_copies", F.xxhash64("conv_id", "turn", "role", "text").alias("_c_tie"), F.col("role").alias("_c_role"), F.col("text").alias("_c_text"),
                      F.spark_partition_id().cast("long").alias("_c_part"), F.monotonically_increasing_id().alias("_c_nth")))
    ranged = stored(ranged, "chat-parts")
    skeleton = ranged.select("_c_part", "_c_nth", "_c_conv", "_c_role", "_c_tie")
    runs = stored(skeleton.groupBy("_c_part").applyInArrow(summarise(table), SEGMENT), "chat-runs")
    cut = runs.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("conv")
    choices = runs.join(cut, "conv").groupBy("conv").applyInArrow(choose(close), CHOICE)
    kinds = dict(turns.dtypes)
    return ranged.groupBy("_c_part").cogroup(choices.groupBy("part")).applyInArrow(
        rewrite(costs, template),
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, copies long, position long, new_role string, action string, "
        "n_inserted long, cost long, total_cost long, rendered string")

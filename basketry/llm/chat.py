"""Chat formatting with minimum-cost role repair.

A conversation is legal when it is an optional system turn, then user and assistant turns in alternation, ending with the
assistant. Repair chooses, turn by turn, to keep it, to merge it into the message before (same role again), to relabel it, or
to insert empty messages before it; no turn is dropped. The choice is the cheapest path through the automaton of legal
turns, found by dynamic programming; ties go to the earlier action in the order of ``ACTIONS``, then to fewer insertions.

Scale: the cost of a run of turns is a min-plus matrix over the automaton's four states, and matrices of neighbouring runs
multiply. The table is range-partitioned in conversation order; each partition sends the matrices of the (at most two)
conversations that reach over its edges, the driver joins those - two rows per partition - and each partition then
repairs its turns from the states fixed at its edges. A conversation with a third of all turns is so many partitions.

Output: a row per turn; the concatenation of ``rendered`` in order is the formatted conversation, so no conversation is
gathered into one value.

Defined cases: turns with equal numbers are ordered by role and text; repeated rows are turns of their own; a null
or unknown role has to be relabelled (at its own cost); a null text is an empty one; rows with a null conv_id are one
conversation; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import cut_lineage

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {v: k for k, v in ROLES.items()}
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ACTIONS = ("keep", "merge", "relabel", "relabel_merge")
#: Costs of a merge, of a relabelled turn, of one without a known role, and of an empty message.
MERGE, RELABEL, UNNAMED, INSERT = 1, 3, 1, 2
FAR = 1 << 40


def _insertions(state: int, most: int = 3) -> list[tuple[int, ...]]:
    """Legal sequences of empty messages from a state, shortest first."""
    out, layer = [()], [((), state)]
    for _ in range(most):
        layer = [(done + (x,), x) for done, at in layer for x in LEGAL[at]]
        out += [done for done, _ in layer]
    return out


@lru_cache(maxsize=None)
def options(role: int) -> dict[tuple[int, int], tuple]:
    """``(state, next state) -> (cost, action, roles inserted before)`` of the cheapest way to take a turn of a role (0: unknown)."""
    best: dict[tuple[int, int], tuple] = {}
    for state in range(4):
        for inserted in _insertions(state):
            at = inserted[-1] if inserted else state
            ways = []
            for new in (SYSTEM, USER, ASSISTANT):
                relabel = 0 if new == role else UNNAMED if role == START else RELABEL
                if new in LEGAL[at]:
                    ways.append((relabel, 2 if relabel else 0, new))
                elif new == at and not inserted:
                    ways.append((relabel + MERGE, 3 if relabel else 1, new))
            for cost, action, new in ways:
                way = (cost + INSERT * len(inserted), action, len(inserted), inserted)
                if (state, new) not in best or way[:3] < best[state, new][:3]:
                    best[state, new] = way
    return {k: (c, ACTIONS[a], i) for k, (c, a, _, i) in best.items()}


@lru_cache(maxsize=None)
def closing(state: int) -> tuple[int, tuple[int, ...]]:
    """Cost and empty messages that end a conversation."""
    for inserted in _insertions(state):
        if (inserted[-1] if inserted else state) == ASSISTANT:
            return INSERT * len(inserted), inserted
    raise AssertionError


def advance(costs: list[int], role: int) -> tuple[list[int], list[int]]:
    """Cheapest costs of each state after a turn, and the state that each came from."""
    new, origin = [FAR] * 4, [-1] * 4
    for (a, b), (cost, _, _) in options(role).items():
        if costs[a] + cost < new[b]:
            new[b], origin[b] = costs[a] + cost, a
    return new, origin


def repair(roles: list[int], start: int = START, end: int | None = None) -> list[tuple[int, int]]:
    """``(state before, state after)`` of each turn on the cheapest path from ``start`` to ``end`` (None: the cheapest legal end)."""
    costs, origins = [FAR] * 4, []
    costs[start] = 0
    for role in roles:
        costs, origin = advance(costs, role)
        origins.append(origin)
    state = end if end is not None else min(range(4), key=lambda s: costs[s] + closing(s)[0])
    path = []
    for origin in reversed(origins):
        path.append((origin[state], state))
        state = origin[state]
    return path[::-1]


def matrix(roles: list[int]) -> list[list[int]]:
    """Cheapest cost from every state to every state over a run of turns."""
    out = []
    for start in range(4):
        costs = [FAR] * 4
        costs[start] = 0
        for role in roles:
            costs, _ = advance(costs, role)
        out.append(costs)
    return out


def _runs(conversations: list) -> list[tuple[int, int]]:
    """Where the turns of each conversation begin and end in a sorted partition."""
    cuts = [0, *(k for k in range(1, len(conversations)) if conversations[k] != conversations[k - 1]), len(conversations)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("seq")


def _edges(table: pa.Table) -> pa.Table:
    """First and last conversation of a partition, with their matrices."""
    t = _sorted(table)
    conv, role = t.column("conv").to_pylist(), t.column("code").to_pylist()
    runs = _runs(conv)
    rows = [(t.column("part")[0].as_py(), first, conv[a], len(runs), sum(matrix(role[a:b]), [])) for first, (a, b) in ((True, runs[0]), (False, runs[-1]))]
    kinds = (pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.list_(pa.int64()))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "is_first", "conv", "runs", "costs"])


def fixed_states(edges: list) -> dict[int, tuple[int, bool, int | None]]:
    """``part -> (state at its first turn, whether that turn begins a conversation, state after its last turn or None at an end)``."""
    parts = sorted({e.part for e in edges})
    at = {(e.part, e.is_first): e for e in edges}
    out = {p: [START, True, None] for p in parts}
    k = 0
    while k < len(parts):
        # the last conversation of partition k, as far as it reaches
        chain, conv = [(parts[k], at[parts[k], False])], at[parts[k], False].conv
        j = k + 1
        while j < len(parts) and at[parts[j], True].conv == conv:
            chain.append((parts[j], at[parts[j], True]))
            j += 1
            if at[parts[j - 1], True].runs > 1:
                break
        if len(chain) > 1:
            costs, origins = [0, FAR, FAR, FAR], []
            for _, e in chain:
                step = [e.costs[4 * s:4 * s + 4] for s in range(4)]
                best = [min((costs[s] + step[s][t], s) for s in range(4)) for t in range(4)]
                costs, origin = [c for c, _ in best], [s for _, s in best]
                origins.append(origin)
            state = min(range(4), key=lambda s: costs[s] + closing(s)[0])
            for n in range(len(chain) - 1, 0, -1):
                state = origins[n][state]
                out[chain[n][0]][:2] = [state, False]
                out[chain[n - 1][0]][2] = state
        k = j - 1 if len(chain) > 1 and at[parts[j - 1], True].runs > 1 else j
    return {p: tuple(v) for p, v in out.items()}


def render(conversation_begins: bool, conversation_ends: bool, path: list[tuple[int, int]], roles: list[int], texts: list[str]) -> list[tuple[str, str, list[str], str]]:
    """Role, action, inserted roles and rendered text of each turn."""
    out = []
    for k, ((a, b), role, text) in enumerate(zip(path, roles, texts)):
        _, action, inserted = options(role)[a, b]
        parts = []
        if "merge" in action:
            parts.append("\n" + text)
        else:
            if not (k == 0 and conversation_begins):
                parts.append("<|end|>\n")
            parts += [f"<|{NAMES[x]}|>\n<|end|>\n" for x in inserted]
            parts.append(f"<|{NAMES[b]}|>\n{text}")
        names = [NAMES[x] for x in inserted]
        if conversation_ends and k == len(path) - 1:
            after = closing(b)[1]
            parts += ["<|end|>\n", *(f"<|{NAMES[x]}|>\n<|end|>\n" for x in after)]
            names += [NAMES[x] for x in after]
        out.append((NAMES[b], action, names, "".join(parts)))
    return out


def formatted(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, repaired_role, action, inserted, rendered`` of every turn."""
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    code = F.coalesce(*(F.when(F.col("role") == name, F.lit(k)) for name, k in ROLES.items()), F.lit(START))
    order = ["conv_id", "turn", "role", "_tie", "_row"]
    keyed = rows.withColumn("_tie", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())  # equal rows may part anywhere
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id())
    stored = cut_lineage(placed.select("part", "seq", "conv_id", F.col("conv_id").cast("string").alias("conv"), "turn", "role", code.alias("code"), "text"))
    edges = stored.select("part", "seq", "conv", "code").groupBy("part").applyInArrow(_edges, "part int, is_first boolean, conv string, runs int, costs array<bigint>").collect()
    sent = turns.sparkSession.sparkContext.broadcast(fixed_states(edges))
    kind = stored.schema["conv_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        t = _sorted(table)
        start, begins, end = sent.value[t.column("part")[0].as_py()]
        conv, codes, texts = (t.column(c).to_pylist() for c in ("conv", "code", "text"))
        runs, out = _runs(conv), []
        for k, (a, b) in enumerate(runs):
            first = start if k == 0 else START
            last = end if k == len(runs) - 1 else None
            path = repair(codes[a:b], first, last)
            out += render(k > 0 or begins, last is None, path, codes[a:b], texts[a:b])
        new, action, inserted, rendered = zip(*out)
        return pa.table([t.column("conv_id"), t.column("turn"), t.column("role"), pa.array(new), pa.array(action), pa.array(inserted, pa.list_(pa.string())), pa.array(rendered)],
                        names=["conv_id", "turn", "role", "repaired_role", "action", "inserted", "rendered"])

    return stored.groupBy("part").applyInArrow(run, f"conv_id {kind}, turn bigint, role string, repaired_role string, action string, inserted array<string>, rendered string")
